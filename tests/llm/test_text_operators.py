"""Operators on texts against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from blocklens.llm import bpe, wordblocks
from blocklens.llm.exact_dedup import exact_dedup
from blocklens.llm.license_scan import license_scan
from blocklens.llm.line_dedup import line_dedup
from blocklens.llm.queries import BPE_TOKENIZER, COUNT_MODEL, tokenizer_file
from blocklens.llm.token_counts import token_counts

from .conftest import TEXTS


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_chars", [1, 10_000_000])
def test_token_counts_are_the_librarys(odd_docs, no_docs, block_chars):
    import sentencepiece

    path = tokenizer_file(COUNT_MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in TEXTS)
    assert _rows(token_counts(odd_docs, path, block_chars=block_chars)) == want
    assert token_counts(no_docs, path).count() == 0


@pytest.mark.parametrize("block_chars", [1, 10_000_000])
def test_bpe_is_the_librarys_and_decodes(odd_docs, no_docs, block_chars):
    import tokenizers

    path = tokenizer_file(BPE_TOKENIZER)
    tok = tokenizers.Tokenizer.from_file(path)
    ids = {(i, t): tok.encode(t or "", add_special_tokens=False).ids for i, t, _ in TEXTS}
    out = bpe.encode(odd_docs, path, block_chars=block_chars)
    want = Counter((i, tuple(ids[i, t]), t or "") for i, t, _ in TEXTS)
    assert Counter((r[0], tuple(r[1]), r[2]) for r in out.collect()) == want
    assert _rows(bpe.decode(out, path)) == Counter((i, t or "") for i, t, _ in TEXTS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(ids[i, t]), sha(",".join(map(str, ids[i, t]))), sha(t or "")) for i, t, _ in TEXTS)
    assert _rows(bpe.digests(odd_docs, path, block_chars=block_chars)) == want
    assert bpe.encode(no_docs, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a b", " a", "a ", "a  b", "a\n b", "a  b", "é ▁ f", "a▁ b", "a\x1f b c"])
def test_words_join_to_the_text(text):
    assert " ".join(wordblocks.split_words(text)) == text


def test_exact_dedup(odd_docs, no_docs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in TEXTS]
    groups = defaultdict(list)
    for i, n in norm:
        groups[n].append(i)
    keep = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    want = Counter((i, keep[n], len(groups[n]), i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for i, n in norm)
    for buckets in (1, 1 << 16):
        assert _rows(exact_dedup(odd_docs, hash_all=True, prefix_chars=2, buckets=buckets)) == want
    assert exact_dedup(no_docs).count() == 0


def test_line_dedup(spark, no_docs):
    long_ = "This line is long enough to be looked at twice"
    texts = [(i, f"head {i}\n\t{long_.upper() if i % 2 else long_} \n{long_}") for i in range(8)]
    texts += [(8, None), (9, ""), (10, long_ + "\n"), (10, long_ + "\n"), (None, long_), (11, "\n".join(["é" * 40] * 9)),
              (12, "é" * 40), (13, "x\n\n" + "y" * 20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bare = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n") if i is not None else ():
            if len(bare(line)) >= 40:
                holders[bare(line)].add(i)
    want = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[bare(x)]) < 5 or max(holders[bare(x)]) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        assert _rows(line_dedup(docs, batches=batches, fanout=fanout)) == want
    assert line_dedup(no_docs).count() == 0


def test_license_scan(spark, odd_docs, no_docs):
    texts = [(0, "Licensed under CC BY-NC 4.0, all rights reserved. All rights reserved"), (1, "general public licence"),
             (2, "This work is licensed under the (modified) GNU General Public License, version 3."), (3, None),
             (3, "cc cc by by"), (None, "CC-BY"), (4, "all rights\nreserved " * 500), (5, "licensed under the gnu general")]
    got = {(r[0], r[1]): tuple(r[2:]) for r in license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got[0, 13] == (3, 2, 10, "cc-by,reserved", "cc-by,cc-by-nc-4-notice,reserved", 1.0)
    assert got[1, 3] == (0, None, None, "", "", 0.5)
    assert got[2, 13][:4] == (1, 8, 8, "gpl") and got[2, 13][4] == "gpl,gpl-3-notice"  # a word is added inside
    assert got[3, 0] == (0, None, None, "", "", 0.0) and got[3, 4][:3] == (1, 1, 1) and got[None, 2][:3] == (1, 0, 0)
    assert got[4, 1500][:3] == (500, 0, 1497) and got[5, 5][:1] == (0,)
    assert license_scan(odd_docs).count() == len(TEXTS) and license_scan(no_docs).count() == 0


def test_notices_with_one_edit(spark):
    """Every notice exact, and with each word before its tail left out, changed or followed by another; two edits, a
    changed tail and the notices of other versions give no label."""
    from blocklens.llm.license_scan import NOTICES
    texts, want = [], []
    for phrase, label, tail in NOTICES:
        w = phrase.split()
        for i in range(len(w) - tail):
            texts += [" ".join(w), " ".join(w[:i] + w[i + 1:]), " ".join([*w[:i], "other", *w[i + 1:]]),
                      " ".join([*w[:i + 1], "other", *w[i + 1:]])]
            want += [label] * 4
        texts += [" ".join([*w[:-1], "other"]), " ".join(w[2:]), " ".join([*w[:2], "x", "y", *w[2:]]),
                  " ".join(["x", *w[:1], "y", *w[2:-tail], "z", *w[-tail:]]), " ".join(w[:-1])]
        want += [""] * 5
    rows = [(i, f"{'lead in ' * (i % 3)}{t.title() if i % 2 else t}{' . and on' * (i % 2)}") for i, t in enumerate(texts)]
    base = {"cc-by", "gpl", "reserved"}
    got = {r.doc_id: set(r.labels.split(",")) - base - {""} for r in
           license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, {x} - {""}) for t, x in zip(texts, want)]
