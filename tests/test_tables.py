import os

import pytest
from pyspark.sql import functions as F

from blocklens import queries
from blocklens.functions import geometry as geo
from blocklens.functions import similarity as sim
from blocklens.functions import text as tx
from blocklens.operators import ocr, verify
from blocklens.sources import tables

FIELD = "doc_id bigint, field_seq bigint, field_id string, name string, label string, value string"


def test_checks(spark):
    f = spark.createDataFrame([
        (1, 0, "date_of_birth", "Date of Birth", "Date of Birth", "01/15/1990"),
        (1, 1, "policy_number", "Policy Number", "Policy Number", "POL-1"),
        (1, 2, "member_name", "Member Name", "Member Name", "Al"), (1, 3, "signature", "Signature", "Signature", "____")], FIELD)
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "doc_id bigint, filename string")
    want = {"date of birth": ("ok", 100.0), "birth date": ("ok", 100.0), "policy no": ("ok", 80.0),
            "first name": ("not_found", 57.1), "dob": ("not_found", 37.5), "signature": ("null_or_empty", 100.0)}
    c = verify.checks(docs, f, list(want))
    got = {r.concept: (r.status, r.match_score) for r in c.filter("doc_id = 1").collect()}
    assert got == want
    assert {r.status for r in c.filter("doc_id = 2").collect()} == {"not_found"}
    assert tuple(verify.summary(c, 6).first()) == (2, 6, 0, 2, 9)


def test_block_files(spark, tmp_path):
    src = spark.createDataFrame([(1, "b", [10.0, 20.0, 30.0, 31.0], 1), (1, "a", [5.0, 20.0, 9.0, 31.0], 1)],
                                "doc_id bigint, text string, bbox array<double>, page int")
    src.write.json(str(tmp_path / "in"))
    b = tables.read_blocks(spark, str(tmp_path / "in"), "json")
    assert [r.text for r in b.orderBy("block_seq").collect()] == ["a", "b"]
    tables.write_blocks(b, str(tmp_path / "out"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert tables.blocks_json(b).orderBy("block_seq").first().block == '{"text":"a","bbox":[5.0,20.0,9.0,31.0],"page":1}'


def test_folder(spark, tmp_path):
    for n in ("b.pdf", "A.pdf", "c.txt", "d.pdf"):
        (tmp_path / n).write_bytes(b"x")
    files = tables.list_folder(spark, str(tmp_path))
    assert [r.name for r in tables.pick_files(files, count=2).orderBy("position").collect()] == ["A.pdf", "b.pdf"]
    assert [r.name for r in tables.pick_files(files, pick=[3]).collect()] == ["d.pdf"]
    with pytest.raises(IndexError):
        tables.pick_files(files, pick=[4])
    assert os.path.basename(str(tmp_path))


def test_uploads(spark):
    u = spark.createDataFrame([(0, "a.PDF", None), (1, "b.txt", None), (2, "c.pdf", "broken")],
                              "upload_index bigint, filename string, detail string")
    good, bad = tables.split_uploads(u)
    assert [r.filename for r in good.collect()] == ["a.PDF"]
    assert {(r.upload_index, r.detail) for r in bad.collect()} == {(1, tables.SKIPPED_DETAIL), (2, "broken")}
    with pytest.raises(ValueError):
        tables.require_some(good.filter("false"), bad)


def test_deferred_selection(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(True).alias("extraction_pending"))
    chosen, unknown = tables.select_for_extraction(docs, [1, 9])
    assert [r.doc_id for r in chosen.collect()] == [1] and [r.doc_id for r in unknown.collect()] == [9]
    left = tables.mark_extracted(docs, chosen).filter("extraction_pending")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2]


def words(spark, rows):
    return spark.createDataFrame(
        [(1, p, e, 1, dpi, i, t, c, 0.0, 20.0 * i, 40.0, 20.0, 0.5, 0.5) for i, (p, e, dpi, t, c) in enumerate(rows)],
        "doc_id bigint, page int, engine int, ocr_pass int, dpi int, word_seq bigint, text string, conf int, "
        "left double, top double, width double, height double, scale_x double, scale_y double")


def test_engine_choice(spark):
    """Engine 1: 100 characters in 20 words, engine 2: 70 in 5 blocks; it wins on 0.68 of the characters."""
    rows = [(1, 1, 175, "abcde", 90)] * 20 + [(1, 2, 175, "x" * 14, 0)] * 5
    stats = ocr.layer_stats(ocr.clean_words(words(spark, rows)))
    assert ocr.pick_engine(stats, always=True).first().engine == 2
    assert ocr.pick_engine(stats).first().engine == 1
    assert [spark.range(1).select(ocr.retry_dpi(F.lit(d)).alias("v")).first().v for d in (100, 175, 210)] == [128, 224, 228]


def test_merge_layers_with_boxes_of_all_sizes(spark):
    """Against every pair, with page-sized boxes over many words and natives as large."""
    import random
    rng = random.Random(2)

    def boxes(n, sizes):
        out = []
        for i in range(n):
            w, h = rng.choice(sizes)
            x, y = rng.uniform(-50, 600), rng.uniform(-50, 800)
            out.append((i % 2, 1, i, f"t{i}", x, y, x + w, y + h, "s"))
        return out
    sizes = [(30, 11), (60, 30), (255, 12), (257, 12), (300, 400), (1500, 90), (612, 792), (5000, 6000)]
    o, n = boxes(80, sizes), boxes(400, sizes) + [(0, 1, 500 + i, "over", *b[4:8], "s") for i, b in enumerate(boxes(8, sizes))]
    o += [(b[0], 1, 900 + b[2], "copy", b[4] + 1, b[5], b[6] + 3, b[7] + 2, "s") for b in n[:40]]
    schema = "doc_id bigint, page int, block_seq bigint, text string, x0 double, y0 double, x1 double, y1 double, source string"

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter)
    want = [b[2] for b in o] + [b[2] for b in n if not any(a[0] == b[0] and iou(a, b) >= 0.32 for a in o)]
    got = [r.block_seq for r in ocr.merge_layers(spark.createDataFrame(o, schema), spark.createDataFrame(n, schema)).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(o) + len(n) - 40


def test_merge_layers_by_overlap(spark):
    cols = "doc_id bigint, page int, block_seq bigint, text string, x0 double, y0 double, x1 double, y1 double, source string"
    o = spark.createDataFrame([(1, 1, 0, "o", 0.0, 0.0, 100.0, 10.0, "ocr"), (1, 1, 1, "big", 300.0, 0.0, 1300.0, 900.0, "ocr")], cols)
    n = spark.createDataFrame([(1, 1, 0, "drop", 0.0, 0.0, 40.0, 10.0, "native"), (1, 1, 1, "keep", 0.0, 0.0, 20.0, 10.0, "native"),
                               (1, 2, 2, "page", 0.0, 0.0, 100.0, 10.0, "native"),
                               (1, 1, 3, "gone", 320.0, 20.0, 1290.0, 880.0, "native")], cols)
    got = sorted(r.text for r in ocr.merge_layers(o, n).collect())
    assert got == ["big", "keep", "o", "page"]


def test_tall_block_band(spark):
    b = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(100.0).alias("y1"))
    v = spark.range(1).select(geo.slice_box(b, F.lit(10), F.lit(20), F.lit(60)).alias("v")).first().v
    assert (v.y0, v.y1) == pytest.approx((100 / 6, 200 / 6))


def test_names_are_numbered_over_ranges_of_whole_names(spark):
    names = [f"http://same.prefix/{i:03d}" for i in range(60)] + ["B.pdf", "a.pdf"]
    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r.name: r.position for r in tables.number_files(files).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names, key=str.lower))}


def test_upload_order_has_no_gaps(spark):
    docs = spark.createDataFrame([(10 ** 12,), (5,), (7,)], "doc_id bigint")
    assert {r.doc_id: r.upload_index for r in tables.upload_order(docs).collect()} == {5: 0, 7: 1, 10 ** 12: 2}


def test_empty_checklist(spark):
    docs = spark.createDataFrame([(1, "a.pdf")], "doc_id bigint, filename string")
    f = spark.createDataFrame([(1, 0, "", "plan", "Plan", "Gold")],
                              "doc_id bigint, field_seq bigint, field_id string, name string, label string, value string")
    none = verify.checks(docs, f, [" ", ""])
    assert none.count() == 0 and none.columns == verify.checks(docs, f, ["plan"]).columns
    assert [tuple(r) for r in verify.verdicts(none, docs).collect()] == [(1, 0, False, 0)]
    assert verify.checks(docs, f, ["plan"]).first().matched_field_id == "plan"


def test_extraction_replaces_only_its_documents(spark, make_blocks, tmp_path):
    """Other partitions' files stay as they are, a document without fields loses its rows, unknown ids are told."""
    import glob
    from blocklens.operators import fields
    rows = [(d, 1, f"Name: person {d}", 72.0, 60.0, 200.0, 71.0) for d in range(40)]
    docs = spark.createDataFrame([(d, d % 2 == 0) for d in range(40)], "doc_id bigint, extraction_pending boolean")
    path = f"{tmp_path}/fields"
    tables.write_fields(fields.detect_fields(make_blocks(rows)), path)
    before = {f for f in glob.glob(f"{path}/*/*.parquet")}
    changed = make_blocks([(d, 1, f"City: town {d}" if d != 4 else "no field", 72.0, 60.0, 200.0, 71.0) for d in (2, 4)])
    after, unknown = tables.extract_deferred(docs, changed, [2, 4, 99], path, fields.detect_fields)
    assert sorted(r.doc_id for r in after.filter("extraction_pending").collect()) == [d for d in range(0, 40, 2) if d not in (2, 4)]
    assert [(r.doc_id, r.detail) for r in unknown.collect()] == [(99, "not in session")]
    got = {r.doc_id: r.value for r in tables.read_fields(spark, path).collect()}
    assert got == {d: f"person {d}" for d in range(40) if d not in (2, 4)} | {2: "town 2"}
    kept = before & set(glob.glob(f"{path}/*/*.parquet"))
    assert len({f.rsplit("/", 2)[1] for f in before - kept}) <= 2
    tables.extract_deferred(docs, changed.filter("doc_id = 4"), list(range(40)), path, fields.detect_fields)
    assert tables.read_fields(spark, path).count() == 0


def _scans(d):
    return d._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_labels_of_a_checklist_are_read_once(spark, tmp_path):
    f = [(1, 0, "plan", "Plan", "Plan", "Gold"), (1, 1, "order_date", "Order Date", "Order Date", "2001-02-03")]
    spark.createDataFrame(f, "doc_id bigint, field_seq bigint, field_id string, name string, label string, value string"
                          ).write.parquet(f"{tmp_path}/f")
    source = spark.read.parquet(f"{tmp_path}/f")
    best = verify.best_fields(source, ["plan", "order date"])
    assert not any(x in g for x in source.inputFiles() for g in best.inputFiles())
    assert [r.f.field_id for r in best.orderBy("concept_seq").collect()] == ["plan", "order_date"]


def test_routed_pages(spark, tmp_path):
    """Page 1 has text, page 2 only a stamp and OCR words, page 3 little text and no OCR, page 4 OCR alone."""
    b = "doc_id bigint, page int, block_seq bigint, text string, x0 double, y0 double, x1 double, y1 double, source string"
    native = [(1, 1, 0, "a page with plenty of text on it", "native"), (1, 2, 1, "DRAFT", "native"), (1, 2, 2, "few", "native"),
              (1, 3, 3, "short", "native"), (1, 3, 4, "COPY", "native")]
    found = [(1, 1, 0, "unused"), (1, 2, 1, "read"), (1, 4, 2, "alone")]
    spark.createDataFrame([(d, p, n, t, 0.0, 90.0 * n, 50.0, 90.0 * n + 9, s) for d, p, n, t, s in native], b
                          ).write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([(d, p, n, t, 300.0, 90.0 * n, 350.0, 90.0 * n + 9, "ocr", 1, 1, 175) for d, p, n, t in found],
                          b + ", engine int, ocr_pass int, dpi int").write.parquet(f"{tmp_path}/o")
    n, o = spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/o")
    texts = lambda d: sorted((r.page, r.text) for r in d.collect())
    whole, routed = native[0][3], ocr.route_pages(n, o)
    assert texts(routed) == [(1, whole), (2, "read"), (3, "short"), (4, "alone")]
    assert texts(ocr.route_pages(n, o, mixed=True)) == [(1, whole), (1, "unused"), (2, "read"), (3, "short"), (4, "alone")]
    assert _scans(routed) <= 6


@pytest.mark.parametrize("most", [0, 1000])
def test_labels_that_differ_by_a_number_are_scored_once(spark, monkeypatch, most):
    """Scores are those of the texts as they are, with digits in several tokens, in a concept and beyond ASCII."""
    kept = []
    materialise = verify.materialise
    monkeypatch.setattr(verify, "materialise", lambda d: kept.append(materialise(d)) or kept[-1])
    monkeypatch.setattr(verify, "BROADCAST_ROWS", most)
    odd = ["a1b a2 date", "a2 a1b date", "é5 order date", "1 2\t3", "Date 7\x1c8 of", "", "date\n9", "x" * 250 + " 5 date"]
    texts = [f"Order {i} Date" for i in range(30)] + [f"No {i} of {i + 1}" for i in range(3)] + odd
    f = spark.createDataFrame([(i, 0, "", t, t, "v") for i, t in enumerate(texts)], FIELD)
    for concepts in (["order date", "ab a date"], ["order 5 date"]):
        rows = {(r.doc_id, r.concept): r.score for r in verify.best_fields(f, concepts).collect()}
        want = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t.strip()], "i int, t string").select(
            "i", sim.concept_scores(F.array(tx.strip(F.col("t"))), concepts).alias("s")).collect()
        assert rows == {(r.i, c): r.s[k] for r in want for k, c in enumerate(concepts)}
    assert kept[0].count() < 15 and kept[1].count() == 40


def test_layers_are_merged_and_routed_where_the_words_are(spark, tmp_path, request):
    """No word is dealt a second time: documents are, by their id, and nothing else."""
    text = "some words of a page that is neither long nor short and a few more of them"
    spark.createDataFrame([(i, text, "en", "a") for i in range(20)], "doc_id bigint, text string, lang string, source string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit))
    for query in (queries.o_merge, queries.o_route):
        d = query(spark, str(tmp_path))
        dealt = [line for line in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]
        assert dealt and all("hashpartitioning(doc_id#" in x and "REPARTITION_BY_NUM" in x or "Broadcast" in x for x in dealt), dealt
        assert d.count() >= 20 * len(text.split())
