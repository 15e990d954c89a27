import random

import pytest
from pyspark.sql import functions as F

from blocklens.functions import similarity as sim
from blocklens.operators import fields, review
from blocklens.plans import ordered

FORM = [
    (1, 80, 14, "Insurance enrollment form"), (1, 120, 11, "Policy Number: POL-12345678"),
    (1, 160, 11, "Member Name: Alex R. Sample"), (1, 200, 10, "Plan: Gold PPO"),
    (2, 100, 14, "Additional information"), (2, 160, 11, "Date of Birth: 01/15/1990"),
    (2, 220, 10, "Signature: ___________________"), (3, 80, 12, "Subscriber copy"),
    (3, 680, 10, "Subscriber ID / Alt: SUB-887766")]


def form_rows(doc=1):
    return [(doc, p, t, 72.0, float(y - fs), 72 + 0.5 * fs * len(t), y + 0.2 * fs) for p, y, fs, t in FORM]


def column(doc, texts, gap=30.0, page=1, x=72.0):
    return [(doc, page, t, x, 60 + gap * i, x + max(40.0, 5.0 * len(t)), 71 + gap * i) for i, t in enumerate(texts)]


def test_sample_form(make_blocks):
    d = fields.extract_fields(make_blocks(form_rows())).orderBy("priority").collect()
    assert [(r.field_id, r.confidence, r.priority, r.section) for r in d] == [
        ("policy_number", 0.87, 1, "page1_header"), ("member_name", 0.77, 2, "page1_header"),
        ("plan", 0.77, 3, "page1_header"), ("date_of_birth", 0.89, 4, "page2_header"),
        ("subscriber_id_alt", 0.87, 5, "page3_footer")]
    assert not any(r.needs_review for r in d)


def test_queue_moves_on(spark, make_blocks):
    f = fields.extract_fields(make_blocks(form_rows()))
    assert review.next_fields(f).first().field_id == "policy_number"
    done = spark.createDataFrame([(1, "policy_number"), (1, "nope")], "doc_id bigint, field_id string")
    g = review.apply_completions(f, done)
    assert review.next_fields(g).first().field_id == "member_name"
    assert review.unknown_completions(f, done).first().field_id == "nope"
    assert tuple(review.progress(g).first())[1:] == (4, 1, 0)


def test_only_the_first_row_of_an_id_is_completed(spark, make_blocks):
    f = fields.extract_fields(make_blocks(column(1, ["Plan: Gold"]) + column(1, ["Plan: Silver"], page=2)))
    done = spark.createDataFrame([(1, "plan")], "doc_id bigint, field_id string")
    got = {(r.page, r.status) for r in review.apply_completions(f, done).collect()}
    assert got == {(1, "completed"), (2, "pending")}


def test_value_on_the_next_page(make_blocks):
    b = make_blocks(column(1, ["Date of Birth:"]) + column(1, ["01/15/1990"], page=2))
    r = fields.detect_fields(b).first()
    assert (r.field_id, r.page, r.confidence, r.detection) == ("date_of_birth", 2, 0.819, "label_next_plain")


def test_short_name_after_label(make_blocks):
    assert fields.detect_fields(make_blocks(column(1, ["Name:", "Peter Jones"]))).count() == 0


def test_standalone_cap_and_duplicates(make_blocks):
    nums = [f"{10000000 + i}" for i in range(10)]
    d = fields.detect_fields(make_blocks(column(1, nums, gap=80.0))).collect()
    assert len(d) == 8
    b = make_blocks(column(1, ["Plan: x", "Plan: a@b.c"], gap=80.0) + column(1, ["Plan: y"], page=2))
    got = sorted((r.page, r.value) for r in fields.detect_fields(b).collect())
    assert got == [(1, "a@b.c"), (2, "y")]


# ---- the scan against a state table -------------------------------------------------------------------

# Each text by hand: its kind in a free place, whether a label that waits takes it (and shows it), whether it may
# stand below a heading.
BLOCKS = {
    "Name:": ("label", "refused", False), "ab:": ("label", "refused", False),
    "a very long label line that goes on and on for:": ("label", "shown", True),
    "Plan: Gold": ("pair", "refused", False), "Note: ____": ("nothing", "refused", False),
    "9:": ("nothing", "refused", False),
    "Market Segment": ("heading", "refused", True), "Peter Jones": ("heading", "refused", True),
    "a long value without any label in it": ("heading", "shown", True),
    "12/05/2001": ("lone", "shown", True), "12345678": ("lone", "shown", True),
    "____": ("nothing", "hidden", True), "x": ("nothing", "shown", True),
    "Inter-Agency": ("nothing", "refused", True),
    "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve": ("nothing", "shown", True),
}
# state, event -> detection, next state
STEPS = {
    ("free", "label"): (None, "waiting"), ("free", "pair"): ("label_value", "free"),
    ("free", "stack"): ("stacked_label_plain", "below"), ("free", "lone"): ("standalone_pattern", "free"),
    ("free", "nothing"): (None, "free"),
    ("waiting", "shown"): ("label_next_plain", "free"), ("waiting", "hidden"): (None, "free"),
}


def expected(layout):
    """Detections of one document as (position, kind); ``layout`` has (text, joins the next block)."""
    out, state = [], "free"
    for i, (text, joined) in enumerate(layout):
        kind, when_waiting, _ = BLOCKS[text]
        if state == "below":
            state = "free"
            continue
        if state == "waiting" and when_waiting != "refused":
            event = when_waiting
        else:
            state = "free"
            event = ("stack" if joined else "nothing") if kind == "heading" else kind
        found, state = STEPS[state, event]
        if found:
            out.append((i, found))
    return out


def test_scan_matches_the_state_table(make_blocks):
    """Random documents, one of them longer than a chunk and with long runs of copies."""
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(40):
        n = 2500 if doc == 0 else rng.randint(1, 40)
        placed, page, y = [], 1, 60.0
        while len(placed) < n:
            t = rng.choice(list(BLOCKS))
            for _ in range(rng.randint(300, 700) if doc == 0 and rng.random() < 0.2 else 1):
                if rng.random() < 0.1:
                    page, y = page + 1, 60.0
                x = 72.0 if rng.random() < 0.9 else 400.0
                placed.append((page, t, x, y, x + 5.0 * len(t) + 20, y + 11))
                y += rng.choice([20.0, 30.0, 90.0])
        rows += [(doc, *p) for p in placed]
        layout = []
        for up, low in zip(placed, placed[1:] + [None]):
            near = low is not None and up[0] == low[0] and low[3] - up[5] <= 52
            wide = near and min(up[4], low[4]) - max(up[2], low[2]) >= 35
            layout.append((up[1], bool(wide and BLOCKS[low[1]][2])))
        want[doc] = expected(layout)
    d = fields.dynamic_candidates(make_blocks(rows), max_standalone=10 ** 6)
    got = {}
    for r in d.collect():
        got.setdefault(r.doc_id, []).append((r.block_seq, r.detection))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_empty_id_falls_back_to_the_name_and_nulls_overlay(spark):
    shape = "doc_id bigint, field_seq bigint, field_id string, name string, value string, label string, confidence double"
    base = spark.createDataFrame([(1, 0, "", "plan", "Gold", "Plan", 0.5), (1, 1, "id", "id", "7", "Id", 0.5)], shape)
    extra = spark.createDataFrame([(1, 0, "", "plan", "Silver", None, 0.9)], shape)
    got = {(r.name, r.value, r.label) for r in fields.merge_fields(base, extra).collect()}
    assert got == {("plan", "Silver", None), ("id", "7", "Id")}


# ---- keyword mode, merging, corrections ---------------------------------------------------------------

def test_keyword_fields(make_blocks):
    b = make_blocks(form_rows(1) + [(2, 1, "Kip McKid", 72.0, 60.0, 100.0, 71.0),
                                    (2, 3, "Vik VicKo", 72.0, 60.0, 100.0, 71.0)])
    got = {(r.doc_id, r.field_id): (r.value, r.page, r.confidence) for r in fields.keyword_fields(b).collect()}
    assert got[(1, "policy_number")] == ("POL-12345678", 1, 1.0)
    assert got[(1, "date_of_birth")] == ("01/15/1990", 2, 1.0)
    assert got[(2, "full_name")] == ("Vik VicKo", 3, 0.55)


def test_merge_prefers_strictly_better(spark, make_blocks):
    base = fields.detect_fields(make_blocks(form_rows()))
    extra = spark.createDataFrame(
        [(1, 0, "policy_number", "policy_number", "POL-1", 0.87), (1, 1, "plan", "plan", "Silver", 0.9),
         (1, 2, "full_name", "full_name", "Al", 0.5)],
        "doc_id bigint, field_seq bigint, field_id string, name string, value string, confidence double")
    got = {r.field_id: (r.value, r.label) for r in fields.merge_fields(base, extra).collect()}
    assert got["policy_number"] == ("POL-12345678", "Policy Number")
    assert got["plan"] == ("Silver", "Plan")
    assert got["full_name"] == ("Al", None)
    assert len(got) == 6


def test_corrections(spark, make_blocks):
    b = make_blocks(form_rows())
    f = fields.detect_fields(b)
    c = spark.createDataFrame(
        [(1, 0, "plan", True, None, "0.1"), (1, 1, "plan", False, "SUB-887766", "bad")],
        "doc_id bigint, seq bigint, field_id string, value_ok boolean, suggested_value string, adjusted_confidence string")
    got = {r.field_id: r for r in fields.apply_corrections(f, c, b).collect()}
    assert (got["plan"].value, got["plan"].page, got["plan"].confidence) == ("SUB-887766", 3, 0.77)
    assert got["plan"].gpt_validated and not got["policy_number"].gpt_validated


def test_answers_need_a_block(spark, make_blocks):
    a = spark.createDataFrame(
        [(1, 0, "policy_number", "POL-12345678", None, "m"), (1, 1, "other", "x", "1", "m"),
         (1, 2, "full_name", "qqqq", "9", "m")],
        "doc_id bigint, field_seq bigint, field_id string, value string, confidence string, source string")
    d = fields.accept_answers(a, make_blocks(form_rows())).collect()
    assert [(r.field_id, r.page, r.confidence) for r in d] == [("policy_number", 1, 0.75)]


@pytest.mark.parametrize("priority, fid, want", [("7", "x", 7), (None, "full_name", 2), ("bad", "x", 99)])
def test_known_priority(spark, priority, fid, want):
    d = spark.createDataFrame([(priority, fid)], "p string, f string")
    assert d.select(fields.known_priority(F.col("p"), F.col("f"), F.col("f")).alias("v")).first().v == want


@pytest.mark.parametrize("first_page", [False, True])
def test_alignment_against_all_pairs(spark, make_blocks, first_page):
    """Exact values, near misses, tiny texts and values longer than a block, each against every block."""
    rng = random.Random(3)
    words = ["policy", "number", "pol-0017", "a", "7", "ok", "member name", "name", "jones", "x", "2024-01-31", "anna", "été"]
    rows, values = [], []
    for doc in range(25):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        rows += [(doc, 1 + i // 4, t, 72.0, 60.0 + 30 * (i % 4), 400.0, 71.0 + 30 * (i % 4)) for i, t in enumerate(texts)]
        for k in range(6):
            v = list(rng.choice(texts) if k % 2 else " ".join(rng.sample(words, 3)))
            for _ in range(k // 2):
                v[rng.randrange(len(v))] = rng.choice("qz p")
            values.append((doc, k, "".join(v)[:rng.choice([1, 2, 5, 12, 60])]))
    blocks = make_blocks(rows)
    v = spark.createDataFrame(values, "doc_id bigint, field_seq bigint, value string")
    got = {(r.doc_id, r.field_seq): (r.block_seq, round(r.score, 6)) for r in fields.align_values(
        v, blocks, ["doc_id", "field_seq"], first_page_first=first_page).collect()}
    per = {}
    for r in blocks.collect():
        per.setdefault(r.doc_id, []).append(r)
    want = {}
    for doc, k, value in values:
        best = min(((0 if r.page == 1 or not first_page else 1, -round(sim._align(value.strip().lower(), r.text.lower()), 9), r.block_seq)
                    for r in per[doc] if value.strip() and sim._align(value.strip().lower(), r.text.lower()) >= 35), default=None)
        if best:
            want[doc, k] = (best[2], round(-best[1], 6))
    assert got == want and sum(s >= 85 for _, s in want.values()) > 40 and sum(s < 85 for _, s in want.values()) > 10


def test_standalone_numbers_run_over_chunks_in_one_pass(spark, monkeypatch):
    """Five lone numbers at the end of one chunk, the rest of the page's first eight at the start of the next; another
    page and a short document count for themselves. Nothing is written in between."""
    monkeypatch.setattr(fields, "materialise", lambda d: pytest.fail("written in between"))
    edge = ordered.CHUNK_ROWS
    seq, doc = F.col("id") % (edge + 20), F.floor(F.col("id") / (edge + 20))
    lone = (seq >= edge - 5) | (seq < 2)
    b = spark.range(edge + 30).select(
        doc.alias("doc_id"), F.when(seq < 2, 1).otherwise(2).cast("int").alias("page"), seq.alias("block_seq"),
        F.when(lone, (seq + 10000000).cast("string")).otherwise("x").alias("text"), F.lit(72.0).alias("x0"),
        (seq * 80.0).alias("y0"), F.lit(112.0).alias("x1"), (seq * 80.0 + 11).alias("y1"))
    got = sorted((r.doc_id, r.page, int(r.value) - 10000000, r.field_id) for r in fields.detect_fields(b).collect())
    want = [(0, 1, i, i + 1) for i in range(2)] + [(0, 2, edge - 5 + i, i + 1) for i in range(8)] + [(1, 1, i, i + 1) for i in range(2)]
    assert got == [(d, p, s, f"detected_{s + 10000000}_p{p}_{n}") for d, p, s, n in want]


def test_values_that_stand_in_a_block_are_not_scored(spark, make_blocks, monkeypatch):
    """A value inside a block, a block inside a value and equal ones take the first such block without a score; near
    misses, characters no window matches and documents of very many blocks go on to it. Results are those of all pairs."""
    texts = ["Order Date: 1", "order date", "b\0c", "a b\0c d", "x" * 30 + "\0" + "x" * 40]
    rows = [(doc, 1, t, 72.0, 60.0 + 30 * i, 400.0, 71.0 + 30 * i) for doc in (1, 2) for i, t in enumerate(texts)]
    rows += [(2, 2, "order", 72.0, 60.0, 400.0, 71.0)]
    values = ["Order Date", "see order date: 1 now", "ordxr dat", "B\0C", "\0c d", "x\0" + "x" * 40 + "y", "x" * 30 + "\0" + "x" * 40]
    v = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(values)], "doc_id bigint, field_seq bigint, value string")
    scored = []
    likely = fields._likely_pairs
    monkeypatch.setattr(fields, "_likely_pairs", lambda v, *a: scored.extend(
        (r.doc_id, r.field_seq) for r in v.collect()) or likely(v, *a))
    monkeypatch.setattr(fields, "DIRECT_BLOCKS", 5, raising=False)
    got = {(r.doc_id, r.field_seq): (r.block_seq, r.score) for r in fields.align_values(
        v, make_blocks(rows), ["doc_id", "field_seq"]).collect()}
    blocks = texts + ["order"]
    for d in (1, 2):
        for i, t in enumerate(values):
            score, at = max((sim._align(t.lower(), b.lower()), -n) for n, b in enumerate(blocks[:4 + d]))
            assert got[d, i] == (-at, pytest.approx(score)), (d, t)
    assert (1, 0) not in scored and (1, 1) not in scored and (1, 6) not in scored
    assert {(1, 2), (1, 4)} | {(2, i) for i in range(len(values))} <= set(scored)
