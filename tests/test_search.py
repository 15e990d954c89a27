import itertools

import pytest
from conftest import row_of_words
from pyspark.sql import functions as F

from blocklens.operators import dedupe, embedded, hits, search

CASES = [
    ("The cat sat", "cat", "exact"), ("catch cat", "cat", "exact_loose"), ("PolicyNo 7", "policy", "exact_loose"),
    ("(827) 25", "82725", "digit_formatted"), ("82 725", "82725", "digit_formatted"),
    ("82-725", "82725", "digit_formatted"), ("182725", "82725", "exact_loose"), ("9 82 7259", "82725", None),
    ("82¦725", "82725", "line_nospace"), ("date of¦birth", "date of birth", "line"), ("pol¦icy", "policy", "line_nospace"),
    ("résumé", "resume", "line_merged_word"), ("Polcy holder", "policy", "fuzzy_block"),
    ("poiicy", "policy", "fuzzy_block"), ("smyth", "smith", "fuzzy_block"), ("insurence", "insurance", None),
    ("remember", "member", "exact_loose"), ("ref 8¦2 no 7¦25", "8275", None), ("8x¦2y¦7z", "827", "line_digits")]


def test_match_types(make_blocks):
    """All cases at once: one document each, one pass of all queries."""
    qs = sorted({q for _, q, _ in CASES})
    rows = [r for i, (t, _, _) in enumerate(CASES) for r in row_of_words(i, t.split("¦"))]
    got = {(r.doc_id, r.query_id): r for r in search.search_blocks(make_blocks(rows), qs).collect()}
    for i, (t, q, want) in enumerate(CASES):
        hit = got.get((i, qs.index(q)))
        assert (hit.match_type if hit else None) == want, (t, q)


def test_line_box_is_the_union_of_the_slices(make_blocks):
    h = search.search_blocks(make_blocks(row_of_words(1, ["date of", "birth"])), "of birth").first()
    # "of" is characters 5..7 of a 35 pt block at 72; "birth" is the whole block at 112.
    assert (h.x0, h.x1, h.match_type) == (72 + 35 * 5 / 7, 137.0, "line")


def test_stamp_hits(make_blocks):
    b = make_blocks([(1, 1, "EXAMPLE", 100.0, 100.0, 400.0, 180.0), (2, 1, "EXAMPLE", 100.0, 100.0, 140.0, 110.0),
                     (3, 1, "an EXAMPLE here", 100.0, 100.0, 400.0, 180.0)])
    got = {(r.doc_id, r.match_type) for r in search.search_blocks(b, "example").collect()}
    assert got == {(2, "exact"), (3, "exact")}


def test_cascade_is_per_document(make_blocks):
    b = make_blocks([(1, 1, "smith", 72.0, 60.0, 97.0, 71.0), (1, 1, "smyth", 72.0, 160.0, 97.0, 171.0),
                     (2, 1, "smyth", 72.0, 60.0, 97.0, 71.0)])
    got = {(r.doc_id, r.match_type) for r in search.search_blocks(b, "smith").collect()}
    assert got == {(1, "exact"), (2, "fuzzy_block")}


def test_line_longer_than_a_segment(make_blocks):
    """3000 words on one line: a phrase over a segment edge, and digits far apart."""
    words = ["w"] * 3000
    words[255], words[256] = "red", "fox"
    words[40], words[2900] = "a7", "b31"
    rows = [(1, 1, w, 10.0 * i, 100.0, 10.0 * i + 5, 111.0) for i, w in enumerate(words)]
    b = make_blocks(rows)
    h = search.search_blocks(b, ["red fox", "731", "edfo"]).collect()
    got = {r.query_id: r for r in h}
    assert got[0].match_type == "line" and (got[0].x0, got[0].x1) == (2550.0, 2565.0)
    assert got[1].match_type == "line_digits" and (got[1].x0, got[1].x1) == (402.5, 29005.0)
    assert 2 not in got
    assert got[0].snippet.startswith("w w w")


def test_more_queries_than_a_pass(make_blocks):
    words = [f"word{i}" for i in range(20)]
    b = make_blocks([r for i, w in enumerate(words) for r in row_of_words(i, [w])])
    got = {(r.doc_id, r.query_id) for r in search.search_exact(b, words).collect()}
    assert got == {(i, i) for i in range(20)}


def plain_greedy(hs):
    """The greedy rule as a loop over (x0, y0, x1, y1, rank)."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    def same(a, b):
        if iou(a, b) >= 0.38:
            return True
        d = (((a[0] + a[2]) - (b[0] + b[2])) ** 2 + ((a[1] + a[3]) - (b[1] + b[3])) ** 2) ** 0.5 / 2
        ox = max(0, min(a[2], b[2]) - max(a[0], b[0])) / min(a[2] - a[0], b[2] - b[0])
        oy = max(0, min(a[3], b[3]) - max(a[1], b[1])) / min(a[3] - a[1], b[3] - b[1])
        return d <= 32 and ((ox > 0.4 and oy > 0.32) or (d < 14 and (ox > 0.15 or oy > 0.15)))

    kept = []
    for h in sorted(hs, key=lambda h: (h[1], h[0], h[4])):
        at = next((i for i, k in enumerate(kept) if same(h, k)), None)
        if at is None:
            kept.append(h)
        elif h[4] < kept[at][4]:
            kept[at] = h
    return sorted(kept)


@pytest.mark.parametrize("fold", [dedupe.FOLD_HITS, 2])
def test_greedy_dedupe_matches_the_loop(spark, monkeypatch, fold):
    """Folded, and settled in rounds."""
    import random
    monkeypatch.setattr(dedupe, "FOLD_HITS", fold)
    rng = random.Random(7)
    types = ["exact", "line", "fuzzy_block"]
    rows, per = [], {}
    for doc in range(30):
        seen = set()
        for n in range(40):
            x, y = rng.randint(0, 60) * 8.0 + n * 0.01, rng.randint(0, 30) * 8.0 + n * 0.01
            w, h = rng.choice([16.0, 40.0, 64.0]), rng.choice([8.0, 24.0])
            t = rng.choice(types)
            key = (x // 8, y // 8, (x + w) // 8, (y + h) // 8)
            if key in seen:
                continue
            seen.add(key)
            rows.append((doc, 0, 1, n, x, y, x + w, y + h, "s", "ocr", t))
            per.setdefault(doc, []).append((x, y, x + w, y + h, search.MATCH_RANK[t]))
    d = spark.createDataFrame(rows, "doc_id bigint, query_id int, page int, block_seq bigint, x0 double, y0 double, "
                              "x1 double, y1 double, snippet string, source string, match_type string")
    out = {}
    for r in dedupe.ocr_hits(d, search.MATCH_RANK).collect():
        out.setdefault(r.doc_id, []).append((r.x0, r.y0, r.x1, r.y1, search.MATCH_RANK[r.match_type]))
    assert {k: sorted(v) for k, v in out.items()} == {k: plain_greedy(v) for k, v in per.items()}


@pytest.fixture(scope="module")
def items(spark):
    texts = ["The cat sat on a cat", "82¦725", "no (827) 25 x", "policie doc", "a b¦c d"]
    rows = []
    for i, t in enumerate(texts):
        for j, r in enumerate(row_of_words(i, t.split("¦"))):
            rows.append((i, 1, j, *r[2:], r[6]))
    return spark.createDataFrame(rows, "doc_id bigint, page int, item_seq bigint, text string, x0 double, y0 double, "
                                 "x1 double, y1 double, base_y double")


def test_embedded(items):
    got = search_map = {}
    for r in embedded.search_embedded(items, ["cat", "82725", "policy", "policia", "b c"]).collect():
        got.setdefault((r.doc_id, r.query_id), []).append((r.match_type, r.snippet))
    assert sorted(got[(0, 0)]) == [("exact", "The cat sat on a ca"), ("exact", "at sat on a cat")]
    assert got[(1, 1)] == [("digit_formatted", "82 725")]
    assert got[(2, 1)][0][0] == "digit_formatted"
    assert got[(3, 3)] == [("fuzzy_token", "policie doc")]
    assert got[(4, 4)] == [("exact", "a b c d")]
    assert (3, 2) not in search_map


def test_hybrid_keeps_the_higher_priority(items, make_blocks):
    b = make_blocks(row_of_words(0, ["The cat sat on a cat"]) + row_of_words(9, ["only cat"]))
    got = sorted((r.doc_id, r.source, r.priority) for r in hits.hybrid_find(items, b, ["cat"]).collect())
    assert got == [(0, "embedded", 400), (0, "embedded", 400), (9, "ocr", 300)]


def test_reading_order_wraps(make_blocks):
    b = make_blocks([(1, 1, "cat", 72.0, 60.0, 87.0, 71.0), (1, 1, "cat", 20.0, 64.0, 35.0, 75.0),
                     (1, 2, "cat", 20.0, 64.0, 35.0, 75.0)])
    o = hits.in_reading_order(search.search_blocks(b, "cat"))
    got = [(r.hit_no, r.page, r.x0, r.prev_no, r.next_no) for r in o.orderBy("hit_no").collect()]
    assert got == [(0, 1, 20.0, 2, 1), (1, 1, 72.0, 0, 2), (2, 2, 20.0, 1, 0)]
    box = hits.highlights(o, 1, active_no=1).filter(F.col("active")).first()
    assert box.overlay_key == "s-1-1-p1-72-60-87-71"


def test_control_character_in_a_text_keeps_the_box(make_blocks):
    plain, odd = (search.fuzzy_stage(make_blocks([(1, 1, t, 0.0, 0.0, 100.0, 11.0)]), search.make_queries(["policy"]))
                  .first() for t in ("a-b poiicy", "a\x01b poiicy"))
    assert (odd.x0, odd.x1) == (plain.x0, plain.x1) and odd.x1 > odd.x0


def test_unknown_documents_come_last(spark, make_blocks):
    rows = [r for d in (1, 2, 3) for r in row_of_words(d, ["that"])]
    found = search.search_exact(make_blocks(rows), ["that"])
    docs = spark.createDataFrame([(1, 5000), (3, 5)], "doc_id bigint, upload_index int")
    got = [r.doc_id for r in hits.in_reading_order(found, docs).orderBy("hit_no").collect()]
    assert got == [3, 1, 2]


def test_a_table_of_queries_gives_what_the_list_gives(spark, make_blocks):
    rows = [r for d, t in enumerate(["date of birth 1990", "update offbirth", "DRAFT", "Date Of, of birth"]) for r in
            [(d, 1, t, 72.0, 60.0, 572.0, 71.0)]]
    texts = ["date of", "of birth", "birth", "of", "draft", "none such", "1990"]
    want = search.search_exact(make_blocks(rows), texts)
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    got = search.search_many(make_blocks(rows), asked)
    view = lambda d: sorted(tuple(r) for r in d.select("doc_id", "query_id", "x0", "x1", "snippet", "match_type").collect())
    assert view(got) == view(want) != []


def test_fuzzy_scores_only_what_may_fit(make_blocks, monkeypatch):
    """Tokens with too few characters of the query get no score; the first close token is the same."""
    score = search.sim.ratio
    monkeypatch.setattr(search.sim, "ratio", lambda c, q: F.when(
        F.contains(c, F.lit("zz")), F.raise_error(F.lit("scored")).cast("double")).otherwise(score(c, q)))
    words = ["".join(w) for k in (2, 3, 4, 5) for w in itertools.islice(itertools.product("smithx", repeat=k), 0, None, 7 ** (k - 2))]
    words += ["smith", "smth", "smit", "mith", "smi", "ssmith", "smithxs", "htims", "smxith", "sxmxith", "smyth", "smiht"]
    rows = [r for i, w in enumerate(words) for r in row_of_words(i, ["zzzzt " + w])]
    got = {r.doc_id for r in search.search_fuzzy(make_blocks(rows), "smith").collect()}
    need = search.sim.block_thresholds("smith", "smith")[1]
    assert got == {i for i, w in enumerate(words) if search.sim.ratio_text(w, "smith") >= need} and got
