"""The corpus pipeline, stage by stage, against brute force on each stage's input."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import tokenizers

import corpus_pipeline
from blocklens.llm import mixing
from blocklens.llm.queries import BPE_TOKENIZER, tokenizer_file

from .test_group_operators import _edited, _roots


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randint(1, 400)}" for _ in range(rng.randint(30, 90))) for _ in range(60)]
    texts += [_edited(rng, texts[k].split(), 1) for k in range(20)] + [t.replace(" ", "  ") for t in texts[:10]]
    texts += ["!! ".join(t.upper().split()) for t in texts[:40]] + ["", None, "one"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or ""))) for i, t in enumerate(texts)],
                          "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None

    good = stages["quality classifier"](spark, docs, str(tmp_path)).collect()
    assert good and not any("!!" in (r.text or "") for r in good)
    assert sum("!!" not in (t or "") for t in texts) - len(good) <= 3
    frame = lambda r: spark.createDataFrame(r, docs.schema)
    single = stages["exact dedup"](spark, frame(good), str(tmp_path)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in single} == set(first.values())
    near = stages["MinHash near-dedup"](spark, frame(single), str(tmp_path)).collect()
    sets = {}
    for r in single:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in near} == set(_roots(sets, links).values()) and len(near) < len(single)
    mixed = stages["mixing sources"](spark, frame(near), str(tmp_path))
    assert mixed.columns == docs.columns and sorted(mixed.collect(), key=str) == sorted(near, key=str)
    tok = tokenizers.Tokenizer.from_file(tokenizer_file(BPE_TOKENIZER))
    want = {r.doc_id: (tok.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in near}
    for out in (stages["BPE encoding"](spark, mixed, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        assert {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()} == want


def test_mixture_reaches_the_result(spark, tmp_path, monkeypatch):
    """With one block a document, the sources of the result's rows take turns as brute force has it."""
    monkeypatch.setattr(mixing.mix, "__kwdefaults__", mixing.mix.__kwdefaults__ | {"block_bytes": 1})
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    source = {i: "a" if i < 400 else "b" if i < 425 else "c" for i in range(525)}  # weights 20, 5, 10
    spark.createDataFrame([(i, chr(33 + i % 90), s) for i, s in source.items()],
                          "doc_id bigint, text string, source string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.position)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.position for r in rows] == list(range(525)) and {r.doc_id for r in rows} == set(source)
    left, weight, want = Counter(source.values()), {"a": 20, "b": 5, "c": 10}, Counter()
    seen = Counter()
    for r in rows:
        live, room = [s for s in left if want[s] < left[s]], Fraction(1)
        while room and live:
            total = sum(weight[s] for s in live)
            step = min([room, *(Fraction(left[s] - want[s]) * total / weight[s] for s in live)])
            want.update({s: step * weight[s] / total for s in live})
            room, live = room - step, [s for s in live if want[s] < left[s]]
        seen[source[r.doc_id]] += 1
        assert all(abs(seen[s] - want[s]) < 1 for s in left)


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    rows = spark.range(1000, numPartitions=4).selectExpr("999 - id AS doc_id", "string(id) AS text")
    rows.write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/t")
    for docs in (rows, spark.read.parquet(f"{tmp_path}/t")):
        got = corpus_pipeline.in_file_order(docs).collect()
        assert sorted((r.position, r.doc_id, r.text) for r in got) == [(i, 999 - i, str(i)) for i in range(1000)]
