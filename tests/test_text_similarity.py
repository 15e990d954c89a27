import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from blocklens.functions import similarity as sim
from blocklens.functions import text as tx


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_norm_matches_unicode_rule_on_every_kind_of_text(spark):
    rng = random.Random(3)
    pools = ["abc XYZ é́   \t", "ﬁ½™ＡＢＣ①", "한국어 가각", "Ωσς ΑΣ", "がぎ 　x", "İIı ẞß"]
    rows = [("".join(rng.choice(p) for _ in range(12)),) for p in pools for _ in range(30)]
    d = tx.with_norm(spark.createDataFrame(rows, "t string"), "t").collect()
    assert [(r.t, r.norm) for r in d if r.norm != tx.norm_text(r.t)] == []
    assert tx.norm_text("Ré  SUMÉ ") == "re sume"
    assert unicodedata.normalize("NFKD", "ﬁ") == "fi"


def test_norm_keeps_blocks_where_they_were_dealt(spark):
    """Every character that expands, alone and among others, follows the rule without a Python step; nulls stay."""
    many = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c <= 0xDFFF and len(tx.norm_text(chr(c))) > 1]
    texts = [*many, *("É" + c + "\t" + c + "x\x01 " for c in many), "한국어 ½ \U0002f800 ﬁ", None, ""]
    d = tx.with_norm(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3, "i"), "t")
    plan = d.groupBy("i", "norm").count()._jdf.queryExecution().executedPlan().toString()
    assert len(many) > 10000 and "Python" not in plan and plan.count("Exchange ") == 1
    assert [(r.t, r.norm) for r in d.collect() if r.norm != (None if r.t is None else tx.norm_text(r.t))] == []


@pytest.mark.parametrize("label, want", [
    ("Subscriber ID / Alt", "subscriber_id_alt"), ("***", "field"), ("Policy  Number", "policy_number")])
def test_slug(spark, label, want):
    assert one(spark, tx.slug(F.lit(label))) == want


@pytest.mark.parametrize("t, is_id, is_date", [
    ("AB-1234567", True, False), ("12345", False, False), ("12345678", True, False), ("1/2/24", False, True),
    ("2024-01-02", False, True), ("sub 4455", True, False)])
def test_standalone_patterns(spark, t, is_id, is_date):
    assert one(spark, tx.is_id_alone(F.lit(t))) is is_id
    assert one(spark, tx.is_date_alone(F.lit(t))) is is_date


def test_value_tests(spark):
    assert one(spark, tx.looks_like_title_hyphen(F.lit("Inter-Agency")))
    assert one(spark, tx.stacked_value_ok(F.lit("Peter Jones")))
    assert not one(spark, tx.stacked_value_ok(F.lit("Name")))
    assert not one(spark, tx.looks_like_plain_value(F.lit("Peter Jones")))
    assert one(spark, tx.looks_empty(F.lit(" _-. ")))


@pytest.mark.parametrize("raw, want", [
    ('["DOB","Name"]', ["DOB", "Name"]), ('"DOB"', ["DOB"]), ("DOB\nName\n", ["DOB", "Name"]), ("5", ["5"]),
    ("  ", []), ("[]", []), ("[broken", ["[broken"]), ('{"a":1}', ['{"a":1}'])])
def test_checklists(spark, raw, want):
    assert one(spark, tx.parse_checks(F.lit(raw))) == want


def test_boundary_positions_overlap(spark):
    assert one(spark, tx.phrase_indices(F.lit("a a a catch a"), "a a")) == [0, 2]
    assert one(spark, tx.phrase_indices(F.lit("cat catch cat."), "cat")) == [0, 10]
    assert one(spark, tx.first_phrase_index(F.lit("catch (cat)"), "cat")) == 7


def test_flexible_digits(spark):
    spans = one(spark, tx.flexible_digits_spans(F.lit("(827) 25, 182725 82-725"), "82725"))
    assert [(s.c0, s.c1) for s in spans] == [(1, 8), (17, 23)]
    assert one(spark, tx.flexible_digits_span(F.lit("9 82 7259"), "82725")) is None


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def plain_ratio(a, b):
    return 100.0 * (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) if a or b else 100.0


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    def side(s, t):
        return max(plain_ratio(s, t[max(0, k):k + len(s)]) for k in range(1 - len(s), len(t)))
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(side(s, t), side(t, s)) if len(a) == len(b) else side(s, t)


def test_scores_against_plain_recursion(spark):
    rng = random.Random(5)
    def word():
        return "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 11)))
    texts = [word() for _ in range(60)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for q in ("abc", "a", "cab éa", "abcabcab"):
        got = d.select("t", sim.ratio(F.col("t"), q).alias("r"), sim.partial_ratio(F.col("t"), q).alias("p")).collect()
        for r in got:
            assert r.r == pytest.approx(plain_ratio(q, r.t))
            assert r.p == pytest.approx(plain_partial(q, r.t))


@pytest.mark.parametrize("a, b, want", [
    ("policy", "polcy", 90.909), ("policy", "poiicy", 83.333), ("smith", "smyth", 80.0),
    ("insurance", "insurence", 88.889), ("member", "remember", 85.714)])
def test_known_ratios(spark, a, b, want):
    assert one(spark, sim.ratio(F.lit(b), a)) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("c, label, want", [
    ("date of birth", "date of birth", 100), ("birth date", "date of birth", 100), ("policy no", "policy number", 80.0),
    ("first name", "member name", 57.1), ("dob", "date of birth", 25.0), ("", "x", 0)])
def test_token_set(spark, c, label, want):
    assert one(spark, sim.token_set_ratio(F.lit(label), c)) == pytest.approx(want, abs=0.05)


def plain_token_set(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both = " ".join(sorted(ta & tb))
    mine, rest = sorted(ta - tb), sorted(tb - ta)
    if both and not (mine and rest):
        return 100.0
    left, right = " ".join([*([both] if both else []), *mine]), " ".join([*([both] if both else []), *rest])
    # The shared head matches itself, so only what follows it is aligned.
    head = len(both) + 1 if both else 0
    close = 100.0 * (1 - (len(left) + len(right) - 2 * (head + lcs(left[head:], right[head:]))) / (len(left) + len(right)))
    return max(close, plain_ratio(both, left), plain_ratio(both, right)) if both else close


def test_token_scores_against_plain_sets(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "b", "é", "cab", "abba", "bb", "a" * 40]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\u2003"]) for _ in range(rng.randint(0, 6)))
    texts = [text() for _ in range(80)] + ["", " "]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for q in ("ab", "abba b", "bb b ab cab", " ".join(words), ""):
        got = d.select("t", sim.token_set_ratio(F.col("t"), q).alias("s"), sim.token_sort_ratio(F.col("t"), q).alias("o"),
                       sim.concept_scores(F.array("t", F.lit("B abba")), [q, "cab"]).alias("c")).collect()
        for r in got:
            assert r.s == pytest.approx(plain_token_set(q, r.t)), (q, r.t)
            assert r.o == pytest.approx(plain_ratio(" ".join(sorted(r.t.split())), " ".join(sorted(q.split()))))
            assert r.c == pytest.approx([max(plain_token_set(k, r.t), plain_token_set(k, "b abba")) for k in (q, "cab")])
    assert one(spark, sim.token_set_ratio(F.lit(None).cast("string"), "a")) is None


def test_long_queries(spark):
    """Queries of one word of bits, exactly two, and more."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 150))) for _ in range(25)] + [""]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for n in (59, 60, 61, 120, 121, 190):
        q = "".join(rng.choice("abcd ") for _ in range(n))
        for r in d.select("t", sim.ratio(F.col("t"), q).alias("r")).collect():
            assert r.r == pytest.approx(plain_ratio(q, r.t)), n


def test_reply_objects(spark):
    v = one(spark, tx.parse_reply_objects(F.lit('ok [1, {"a":"x","b":2}, "s"] end'), "a string, b int"))
    assert [(o.a, o.b) for o in v] == [("x", 2)]


def test_superscripts_are_digits_in_one_layer_only(spark):
    t = F.lit("82²725")
    assert one(spark, tx.flexible_digits_span(t, "82725")) is None
    assert one(spark, tx.flexible_digits_span(t, "82725", tx.ASCII_DIGIT)) is not None


def test_label_and_digit_tests_over_all_kinds_of_digits(spark):
    """The short forms for ASCII texts and the early stops say what the counts over whole texts say."""
    texts = ["Policy Number", "a1", "ab", "a", "1a2b3", "12 ab", "123a456b", "١٢ab", "²³①ab", "éé",
             "x: y", "", " ", "__ - .", "--x", "  ", "a" * 53, "⒈⒉⒐xy1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = {r["t"]: r[1:] for r in df.select(
        "t", tx.looks_like_label(t), tx.looks_empty(t), tx.has_flexible_digits(t, "12"),
        F.coalesce(t.rlike(tx.flexible_digits_pattern("12")), F.lit(False))).collect()}

    def label(s):
        return (2 <= len(s) <= 52 and ":" not in s and sum(c.isalpha() for c in s) >= 2
                and sum(c.isdigit() for c in s) <= len(s) * 0.6)
    for s in texts:
        is_label, empty, fast, full = got[s]
        assert is_label == label(s), s
        assert empty == (not s.translate({ord(c): None for c in "_-."}).strip()), s
        assert fast == full, s
