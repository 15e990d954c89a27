"""Field detection, merging and correction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema
from ..functions import geometry as geo
from ..functions import similarity as sim
from ..functions import text as tx
from ..plans import ordered
from ..plans.stage import materialise, stored

STACKED_MAX_GAP = 52
STACKED_MIN_OVERLAP = 35
STANDALONE_PER_PAGE = 8
#: A value that fits a block so well is placed without a look at blocks that can't fit as well.
SURE = 85.0
#: In documents of so many blocks values are looked for in the blocks as they are, without an index.
DIRECT_BLOCKS = 1024
SEE_PAGE = "(see page)"
BOX_COLS = ("x0", "y0", "x1", "y1")
CANDIDATE = ("doc_id", "block_seq", "field_id", "name", "label", "value", "page", *BOX_COLS,
             "confidence", "detection")


# ---- one block at a time ---------------------------------------------------------------------------

def _label_of(t: Column) -> Column:
    return tx.strip(F.substring_index(t, ":", 1))


def _value_of(t: Column) -> Column:
    return tx.strip(F.substring(t, F.instr(t, ":") + 1, F.length(t)))


def label_value_fields(blocks: DataFrame, *, include_placeholders: bool = False) -> DataFrame:
    """``Label: value`` blocks on their own: a pure projection, no neighbours."""
    t = tx.strip(F.col("text"))
    label, value = _label_of(t), _value_of(t)
    d = blocks.filter(F.contains("text", F.lit(":"))).withColumns({"_l": label, "_v": value}).filter(
        (F.length("_l") >= 2) & (F.col("_v") != "")).withColumn("_blank", tx.looks_empty(F.col("_v")))
    if not include_placeholders:
        d = d.filter(~F.col("_blank"))
    conf = F.when(F.col("_blank"), F.lit(0.40)).otherwise(
        tx.label_value_confidence(F.col("_l"), F.col("_v")))
    det = F.when(F.col("_blank"), "label_placeholder").otherwise("label_value")
    return d.select(
        "doc_id", "block_seq", tx.slug(F.col("_l")).alias("field_id"), F.substring("_l", 1, 120).alias("name"),
        F.substring("_l", 1, 120).alias("label"), F.substring("_v", 1, 500).alias("value"), "page", *BOX_COLS,
        F.round(F.least(F.lit(1.0), conf), 3).alias("confidence"), det.alias("detection"))


# ---- neighbours: the three-state automaton ---------------------------------------------------------
# A block leaves the scan in state N (nothing open), P (``Label:`` waiting for its value) or C (the next
# block is taken as the value of a stacked label). What a block does when it is reached in state N
# depends only on itself and the next block. The state after a block is therefore either N or that
# "own" state, one bit a_i. Reached in C a block always leads back to N; reached in P it leads to N if it
# is consumed and acts as in N otherwise. So a_i is a constant or the negation of a_(i-1): the bit is the
# last constant before it, flipped once per block since. A running maximum finds that constant.

_SHAPE = ("page", *BOX_COLS)


def _features(blocks: DataFrame) -> DataFrame:
    """What one block says by itself: the tests run once per block, before any shuffle.

    ``opens``: ``Label:`` without a value. ``heads``: may be the label of a stacked pair. ``below``: may be
    the value of one. ``taken``: is the value when the block before is an open label."""
    t = F.col("text")
    b = blocks.select("doc_id", "page", "block_seq", tx.strip(t).alias("text"), *BOX_COLS)
    b = b.withColumns({"_label": _label_of(t), "_value": _value_of(t), "_colon": F.contains(t, F.lit(":")),
                       "_empty": tx.looks_empty(t), "_islabel": tx.looks_like_label(t)})
    n, colon, islabel = F.length(t), F.col("_colon"), F.col("_islabel")
    head = F.substring(t, 1, 36)
    pre = tx.strip(F.substring_index(head, ":", 1))
    new_label = F.contains(head, F.lit(":")) & (F.length("_label") >= 3) & pre.rlike(r"\p{L}")
    return b.withColumns({
        "opens": colon & (F.length("_label") >= 2) & (F.col("_value") == ""),
        "heads": islabel & ~tx.looks_like_title_hyphen(t),
        "below": tx.stacked_value_ok(t) & (~F.contains(F.substring(t, 1, 20), F.lit(":")) | (n > 25)),
        "taken": ~new_label & (t != "") & (F.col("_empty") | tx.looks_like_plain_value(t)),
    }).drop("_islabel")


def _stacks(upper: Column, lower: Column) -> Column:
    """Two neighbours form a stacked pair."""
    return (upper["heads"] & lower["below"] & (upper["page"] == lower["page"])
            & (lower["y0"] - upper["y1"] <= STACKED_MAX_GAP)
            & (F.least(upper["x1"], lower["x1"]) - F.greatest(upper["x0"], lower["x0"]) >= STACKED_MIN_OVERLAP))


def _constants(blocks: DataFrame) -> DataFrame:
    """Blocks with their features, neighbours and the constant bit (``_const``) of those that have one."""
    near = ordered.with_neighbours(
        _features(blocks), ["doc_id"], "block_seq", ["text", "opens", "heads", "below", *_SHAPE],
        prev="_p", next="_n")
    here = F.struct("heads", "below", *_SHAPE)
    own = F.when(F.col("opens"), "P").when(F.coalesce(_stacks(here, F.col("_n")), F.lit(False)), "C").otherwise("N")
    before = F.when(F.coalesce(F.col("_p.opens"), F.lit(False)), "P").when(
        F.coalesce(_stacks(F.col("_p"), here), F.lit(False)), "C").otherwise("N")
    d = near.withColumns({"_own": own, "_before": before})
    const = (F.when(F.col("_own") == "N", 0).when(F.col("_before") == "N", 1)
             .when((F.col("_before") == "P") & ~F.col("taken"), 1))
    return d.withColumn("_const", F.when(const.isNotNull(), F.struct("block_seq", const.alias("bit"))))


def scan_states(blocks: DataFrame) -> DataFrame:
    """Blocks with their features and neighbours and the state they are reached in (``state``)."""
    d = ordered.running_max(_constants(blocks), ["doc_id"], "_chunk", ["block_seq"], F.col("_const"), "_last", exclusive=True,
                            beyond=_constants(ordered.beyond_first(blocks, ["doc_id"], "block_seq")))
    flips = F.col("block_seq") - 1 - F.col("_last.block_seq")
    open_before = F.when(F.col("_last").isNull(), F.lit(False)).otherwise(
        (F.col("_last.bit") + flips) % 2 == 1)
    return d.withColumn("state", F.when(open_before, F.col("_before")).otherwise(F.lit("N"))).drop("_const")


def dynamic_candidates(blocks: DataFrame, *, include_placeholders: bool = False,
                       max_standalone: int = STANDALONE_PER_PAGE) -> DataFrame:
    found = _unnumbered(blocks, include_placeholders, max_standalone)
    beyond = _unnumbered(ordered.beyond_first(blocks, ["doc_id"], "block_seq"), include_placeholders, max_standalone)
    return _number_standalone(found, max_standalone, beyond)


def _unnumbered(blocks: DataFrame, include_placeholders: bool, max_standalone: int) -> DataFrame:
    """The candidates, standalone values without their number."""
    d = scan_states(blocks)
    t, value, colon = F.col("text"), F.col("_value"), F.col("_colon")
    taken = (F.col("state") == "P") & F.col("taken")
    free = (F.col("state") == "N") | ((F.col("state") == "P") & ~F.col("taken"))
    one_line = colon & (F.length("_label") >= 2) & (value != "")
    stacked = ~colon & (F.col("_own") == "C")
    lone = ~colon & (t != "") & F.lit(max_standalone > 0) & (tx.is_date_alone(t) | tx.is_id_alone(t))
    kind = (F.when(taken, "next").when(free & one_line, "value").when(free & stacked, "stacked")
            .when(free & lone, "lone"))
    # An explode of zero or one kinds, not a filter: a filter would be copied with everything it is made of
    # into each step below. From here on only the few blocks that yield a field are left.
    k = d.withColumn("_kind", F.explode(F.array_compact(F.array(kind))))
    kind = F.col("_kind")
    k = k.select("doc_id", "block_seq", "page", "text", "_kind", *BOX_COLS, F.col("_n").alias("_n"),
                 F.when(kind == "next", _label_of(F.col("_p.text"))).when(kind == "value", F.col("_label"))
                 .when(kind == "stacked", t).otherwise(F.lit("")).alias("_l"),
                 F.when(kind == "value", value).when(kind == "stacked", F.col("_n.text")).otherwise(t).alias("_v"))
    k = k.withColumn("_blank", (kind.isin("next", "value")) & tx.looks_empty(F.col("_v")))
    if not include_placeholders:
        k = k.filter(~F.col("_blank"))
    blank = F.col("_blank")
    score = tx.label_value_confidence(F.col("_l"), F.when(kind == "next", F.substring("_v", 1, 500)).otherwise(F.col("_v")))
    conf = (F.when(kind == "next", F.when(blank, F.lit(0.36)).otherwise(score * 0.92))
            .when(kind == "value", F.when(blank, F.lit(0.40)).otherwise(score))
            .when(kind == "stacked", F.lit(0.52))
            .otherwise(F.when(tx.is_date_alone(t), F.lit(0.58)).otherwise(F.lit(0.62))))
    det = (F.when(kind == "next", F.when(blank, "label_next_placeholder").otherwise("label_next_plain"))
           .when(kind == "value", F.when(blank, "label_placeholder").otherwise("label_value"))
           .when(kind == "stacked", "stacked_label_plain").otherwise("standalone_pattern"))
    lone_name = F.concat(F.lit("Detected: "), F.substring(t, 1, 56))
    boxes = [F.when(kind == "stacked", F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in BOX_COLS]
    found = k.select(
        "doc_id", "block_seq", tx.slug(F.col("_l")).alias("field_id"),
        F.when(kind == "lone", lone_name).otherwise(F.substring("_l", 1, 120)).alias("name"),
        F.substring("_l", 1, 120).alias("label"), F.substring("_v", 1, 500).alias("value"), "page", *boxes,
        F.round(F.least(F.lit(1.0), conf), 3).alias("confidence"), det.alias("detection"))
    return found


def _number_standalone(cands: DataFrame, cap: int, beyond: DataFrame) -> DataFrame:
    """The first ``cap`` standalone values of a page get their running number, all in one pass over the candidates.

    Rows are numbered inside their chunk. Only documents of more than one chunk (``beyond``: their candidates) need what
    the chunks before hold of the page, one number a chunk and page, joined by broadcast."""
    is_lone = F.col("detection") == "standalone_pattern"
    chunked = lambda d: d.withColumn("_c", ordered.chunk_of(F.col("block_seq")))
    before = W.partitionBy("doc_id", "page").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    held = chunked(beyond.filter(is_lone)).groupBy("doc_id", "page", "_c").agg(F.count(F.lit(1)).alias("_held"))
    held = held.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("_c").alias("_hc"),
                       F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    inner = W.partitionBy("doc_id", "_c", "page", "_lone").orderBy("block_seq")
    d = chunked(cands).withColumn("_lone", is_lone).withColumn("_k", F.row_number().over(inner))
    same = (F.col("doc_id") == F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")) & (F.col("_c") == F.col("_hc"))
    d = d.join(F.broadcast(held), same, "left").withColumn("_n", F.col("_k") + F.coalesce("_before", F.lit(0)))
    s = F.btrim(F.substring(tx.slug(F.substring("value", 1, 40)), 1, 40), F.lit("_"))
    fid = F.concat(F.lit("detected_"), F.when(s == "", F.lit("value")).otherwise(s), F.lit("_p"),
                   F.col("page").cast("string"), F.lit("_"), F.col("_n").cast("string"))
    return d.filter(~F.col("_lone") | (F.col("_n") <= cap)).withColumn(
        "field_id", F.when(F.col("_lone"), fid).otherwise(F.col("field_id"))).select(*CANDIDATE)


def best_per_page(cands: DataFrame) -> DataFrame:
    """Best confidence per (field_id, page); the first one wins ties. The place in the field list is
    that of the first candidate. An aggregate, so copies combine before the shuffle."""
    rest = [c for c in CANDIDATE if c not in ("doc_id", "field_id", "page", "block_seq")]
    best = F.min(F.struct((-F.col("confidence")).alias("k"), F.col("block_seq").alias("s"),
                          F.struct(*rest).alias("r"))).alias("b")
    return (cands.groupBy("doc_id", "field_id", "page").agg(F.min("block_seq").alias("field_seq"), best)
            .select("doc_id", "field_seq", "field_id", "b.r.name", "b.r.label", "b.r.value", "page",
                    *[f"b.r.{c}" for c in BOX_COLS], "b.r.confidence", "b.r.detection"))


def detect_fields(blocks: DataFrame, *, include_placeholders: bool = False,
                  max_standalone: int = STANDALONE_PER_PAGE) -> DataFrame:
    """Schema-free fields: same-line, next-line and stacked label/value pairs, lone dates and ids."""
    return best_per_page(dynamic_candidates(
        blocks, include_placeholders=include_placeholders, max_standalone=max_standalone))


# ---- keyword mode ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class FieldSpec:
    field_id: str
    keywords: tuple[str, ...]
    value_pattern: str
    priority: int
    name_fallback: bool = False


# The known fields, their label words and value patterns.
FIELD_SPECS = (
    FieldSpec("policy_number",
              ("policy", "policy number", "policy #", "policy no", "member id", "subscriber id"),
              r"(?iU)\b(?:[A-Z]{2,3}[-\s]?)?\d{5,12}\b|\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 1),
    FieldSpec("full_name",
              ("name", "member name", "patient name", "subscriber name", "full name"),
              r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b", 2, True),
    FieldSpec("date_of_birth",
              ("dob", "date of birth", "birth date", "birthdate", "d.o.b"),
              tx.DATE_INLINE, 3),
)
# The class [a-z] must stay ASCII under (?U), which it does; \b, \d and \s are the Unicode forms.
NAME_START = r"^[A-Z][a-z]+\s+[A-Z][a-z]+"


def _keyword_value(spec: FieldSpec) -> Column:
    line = F.col("text")
    colon = F.contains(line, F.lit(":"))
    after = F.substring(line, F.instr(line, ":") + 1, F.length(line))
    pat = spec.value_pattern
    return (F.when(line.rlike(pat), tx.strip(F.regexp_extract(line, pat, 0)))
            .when(colon & after.rlike(pat), tx.strip(F.regexp_extract(after, pat, 0)))
            .when(colon, F.substring(tx.strip(after), 1, 80)))


def keyword_fields(blocks: DataFrame, specs: Sequence[FieldSpec] = FIELD_SPECS) -> DataFrame:
    """Best block per document and known field. The candidates of all specs come from one scan and are
    reduced by a partial aggregate; ties go to the first block."""
    d = blocks.select("doc_id", "block_seq", "page", "text", *BOX_COLS,
                      sim.best_keywords(F.col("text"), [s.keywords for s in specs]).alias("_s"))
    d = d.withColumns({f"_v{i}": _keyword_value(s) for i, s in enumerate(specs)})

    def hit(i: int, s: FieldSpec) -> Column:
        score, value = F.col("_s")[i], F.col(f"_v{i}")
        filled = F.coalesce(value != "", F.lit(False))
        base = (score / 100.0) * 0.6 + F.when(filled, F.lit(0.4)).otherwise(F.lit(0.0))
        conf = (F.when(filled & value.rlike(s.value_pattern), F.least(F.lit(1.0), base + 0.15))
                .when(value.isNull() & (score >= 55), score / 100.0 * 0.5).otherwise(base))
        return F.when(value.isNotNull() | (score >= 40), F.struct(
            F.lit(i).alias("i"), F.lit(s.field_id).alias("field_id"), conf.alias("conf"),
            F.when(filled, value).otherwise(F.lit(SEE_PAGE)).alias("value")))

    hits = (d.select("doc_id", "block_seq", "page", *BOX_COLS, F.explode(F.array_compact(
        F.array(*[hit(i, s) for i, s in enumerate(specs)]))).alias("h"))
        .select("doc_id", "block_seq", "page", *BOX_COLS, "h.*").filter(F.col("conf") >= 0.25))
    best = hits.groupBy("doc_id", "i", "field_id").agg(F.min(F.struct(
        (-F.col("conf")).alias("k"), "block_seq", "page", *BOX_COLS, "value")).alias("b"))
    found = best.select(
        "doc_id", F.col("i").cast("bigint").alias("field_seq"), "field_id", "b.value", "b.page",
        *[f"b.{c}" for c in BOX_COLS],
        F.round(F.least(F.lit(1.0), -F.col("b.k")), 3).alias("confidence"))
    if any(s.name_fallback for s in specs):
        found = materialise(found)  # three rows a document at most; read again by the fallback
    parts = [found]
    for i, s in enumerate(specs):
        if s.name_fallback:
            parts.append(_name_fallback(blocks, found, i, s))
    return reduce(DataFrame.unionByName, parts).select(
        "doc_id", "field_seq", "field_id", F.col("field_id").alias("name"),
        F.lit(None).cast("string").alias("label"), "value", "page", *BOX_COLS, "confidence",
        F.lit(None).cast("string").alias("detection"))


def _name_fallback(blocks: DataFrame, found: DataFrame, i: int, s: FieldSpec) -> DataFrame:
    """Two capitalised words at the start of a block: the first on a page, the last such page wins."""
    t = tx.strip(F.col("text"))
    named = blocks.filter(t.rlike(NAME_START)).join(
        found.filter(F.col("field_id") == s.field_id).select("doc_id"), "doc_id", "left_anti")
    last = named.groupBy("doc_id").agg(F.max(F.struct(
        "page", (-F.col("block_seq")).alias("k"), F.substring(t, 1, 120).alias("value"),
        *BOX_COLS)).alias("b"))
    return last.select("doc_id", F.lit(i).cast("bigint").alias("field_seq"),
                       F.lit(s.field_id).alias("field_id"), "b.value", "b.page",
                       *[f"b.{c}" for c in BOX_COLS], F.lit(0.55).alias("confidence"))


# ---- merging, alignment, corrections -----------------------------------------------------------------

def merge_fields(baseline: DataFrame, extra: DataFrame) -> DataFrame:
    """Union by field_id (name when it is missing). The last baseline row of an id is kept; extra rows
    are then applied in order and replace it while their confidence is strictly higher. Columns the
    winner's table lacks keep the older value; a null of the winner counts."""
    cols = list(dict.fromkeys([*baseline.columns, *extra.columns]))
    key = lambda d: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("field_id", "name") if c in d.columns])

    def ranked(d: DataFrame) -> DataFrame:
        return d.withColumn("_id", key(d)).filter(F.col("_id").isNotNull())

    base = ranked(baseline).groupBy("doc_id", "_id").agg(
        F.max_by(F.struct(*baseline.columns), "field_seq").alias("b"), F.min("field_seq").alias("_place"))
    # Applying rows in order while strictly better leaves the first row of the highest confidence.
    add = ranked(extra).groupBy("doc_id", "_id").agg(F.min(F.struct(
        (-F.coalesce("confidence", F.lit(0.0))).alias("k"), "field_seq",
        F.struct(*extra.columns).alias("r"))).alias("e"))
    both = base.join(add, ["doc_id", "_id"], "full")
    wins = F.col("e").isNotNull() & (F.col("b").isNull() | (
        -F.col("e.k") > F.coalesce(F.col("b.confidence"), F.lit(0.0))))

    def pick(c: str) -> Column:
        old = F.col(f"b.{c}") if c in baseline.columns else F.lit(None)
        new = F.col(f"e.r.{c}") if c in extra.columns else F.lit(None)
        if c == "field_seq":
            return F.coalesce("_place", F.col("e.field_seq") + F.lit(1 << 40)).alias(c)
        return F.when(wins, new if c in extra.columns else old).otherwise(old).alias(c)

    return both.select("doc_id", *[pick(c) for c in cols if c != "doc_id"])


def _grams(c: Column) -> Column:
    """All pairs of neighbouring characters, in order."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), F.lit(1))


def _needed(n: Column) -> Column:
    """How many pairs of neighbouring characters a text of ``n`` characters must share with another one to fit it (as
    the shorter of the two) by SURE or better.

    Characters matched one after the other in both texts share a pair; where none is shared, one of the texts skips a
    character. L matched characters with at most g shared pairs so need L - 1 - g skipped ones, hence
    3 L <= n + w + 1 + g over a window of w characters, and the score 2 L / (n + w) stays below 2/3 + 4 (1 + g) / (9 n)
    for every window that is long enough to reach that much at all."""
    return F.greatest(F.lit(0), F.ceil((SURE / 100 - 2 / 3) * 9 / 4 * n - 1 - 1e-9)).cast("int")


def _scored(pairs: DataFrame, keys: Sequence[str], min_score: float, first_page_first: bool) -> DataFrame:
    """Best block of each value among the pairs, as ``m``: a partial aggregate, not a window."""
    scored = pairs.withColumn("score", sim.alignment_score(F.col("_v"), F.col("_text"))).filter(F.col("score") >= min_score)
    first = F.when(F.col("page") == 1, 0).otherwise(1) if first_page_first else F.lit(0)
    return scored.groupBy(*keys).agg(F.min(F.struct(
        first.alias("p"), (-F.col("score")).alias("k"), "block_seq", "page", *BOX_COLS)).alias("m"))


def _likely_pairs(v: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pairs of a document that can fit by SURE or better.

    The shorter text of such a pair shares ``_needed`` of its pairs of characters with the other, so at least one of
    its rarest ones, if as many as it may lack and one more are tried. Rows meet over (document, pair of characters):
    those of a value that are rarest in the document, or those of a block shorter than the value. A document's blocks
    are so dealt over its pairs of characters. Blocks too short to need any are met directly, values too short are
    left out."""
    v = v.withColumn("_m", F.length("_low")).withColumn("_vg", _grams(F.col("_low"))).filter(_needed(F.col("_m")) > 0)
    held = v.groupBy("doc_id").agg(F.max("_m").alias("_longest"))
    b = b.join(held, "doc_id").withColumn("_n", F.length("_blow")).withColumn("_bg", F.array_distinct(_grams(F.col("_blow"))))
    posts = b.select("doc_id", "block_seq", "_n", (F.col("_n") < F.col("_longest")).alias("_short"), F.explode("_bg").alias("_g"))
    b = b.drop("_longest")
    asked = v.select(*keys, "_m", F.explode(F.array_distinct("_vg")).alias("_g"), "_vg")
    asked = asked.withColumn("_times", F.size(F.filter("_vg", lambda g: g == F.col("_g")))).drop("_vg")
    often = posts.join(asked.select("doc_id", "_g").distinct(), ["doc_id", "_g"], "left_semi").groupBy("doc_id", "_g").agg(
        F.count(F.lit(1)).alias("_often"))
    asked = asked.join(often, ["doc_id", "_g"])  # what no block has can't be shared
    may_lack = F.col("_m") - 1 - _needed(F.col("_m"))
    rare = W.partitionBy(*keys).orderBy("_often", "_g").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_times").over(W.partitionBy(*keys))
    lost = F.col("_m") - 1 - total  # positions that no block of the document has
    asked = asked.withColumn("_tried", lost + F.coalesce(F.sum("_times").over(rare), F.lit(0)) <= may_lack)
    met = asked.join(posts, ["doc_id", "_g"]).filter(
        F.when(F.col("_n") < F.col("_m"), F.col("_short")).otherwise(F.col("_tried"))).select(*keys, "block_seq").distinct()
    tiny = b.filter(_needed(F.col("_n")) == 0).select("doc_id", "block_seq").join(
        v.select(*keys), "doc_id").select(*keys, "block_seq")
    pairs = met.union(tiny).distinct().join(v, list(keys)).join(b, ["doc_id", "block_seq"])
    shared = F.size(F.filter("_vg", lambda g: F.array_contains("_bg", g)))
    return pairs.filter(shared >= _needed(F.least("_m", "_n"))).drop("_m", "_n", "_vg", "_bg", "_low", "_blow")


def _contained(v: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First block of a document of up to DIRECT_BLOCKS blocks that holds the value or is held by it, which is a fit of
    100, as ``m`` of :func:`_scored`. The partial score never matches U+0000."""
    large = b.filter(F.col("block_seq") >= DIRECT_BLOCKS).select("doc_id").distinct()  # one in DIRECT_BLOCKS rows
    low, text = F.col("_low"), F.col("_blow")
    clean = lambda c: (F.length(c) > 63) | ~F.contains(c, F.lit("\0"))
    fits = (low == text) | (F.contains(text, low) & clean(low)) | (F.contains(low, text) & clean(text))
    pairs = v.select(*keys, "_low").join(b.join(F.broadcast(large), "doc_id", "left_anti"), "doc_id").filter(fits)
    return pairs.groupBy(*keys).agg(F.min(F.struct(F.lit(0).alias("p"), F.lit(-100.0).alias("k"), "block_seq", "page", *BOX_COLS)).alias("m"))


def align_values(values: DataFrame, blocks: DataFrame, keys: Sequence[str], *, min_score: float = 35,
                 first_page_first: bool = False) -> DataFrame:
    """Best block of the same document for each value: ``keys`` identify a value row and include doc_id.

    A value that a block contains needs no score (:func:`_contained`). Of the others first only pairs that can fit by SURE
    or better are scored (:func:`_likely_pairs`). A value with such a block has its best one among them; the others are
    compared with all blocks of their document. ``first_page_first`` tries page 1 and falls back to the whole document."""
    v = values.withColumn("_v", F.substring(tx.strip(F.col("value")), 1, 120)).filter(F.col("_v") != "").select(
        *keys, "_v", F.lower("_v").alias("_low"))
    b = blocks.filter(tx.strip(F.col("text")) != "").select(
        "doc_id", "block_seq", "page", *BOX_COLS, F.col("text").alias("_text"), F.lower("text").alias("_blow"))
    near = b.filter(F.col("page") == 1) if first_page_first else b
    held = materialise(_contained(v, near, keys).filter(F.lit(min_score <= 100)))
    v = v.join(held, list(keys), "left_anti")
    found = _scored(_likely_pairs(v, near, keys), keys, max(min_score, SURE), first_page_first)
    found = materialise(found.unionByName(held))
    rest = v.join(found, list(keys), "left_anti").select(*keys, "_v").join(b.drop("_blow"), "doc_id")
    best = found.unionByName(_scored(rest, keys, min_score, first_page_first))
    return best.select(*keys, F.col("m.page").alias("page"), *[F.col(f"m.{c}").alias(c) for c in BOX_COLS],
                       (-F.col("m.k")).alias("score"), F.col("m.block_seq").alias("block_seq"))


KNOWN_IDS = ("policy_number", "full_name", "date_of_birth")


def accept_answers(answers: DataFrame, blocks: DataFrame, *, allowed: Sequence[str] = KNOWN_IDS,
                   first_page_first: bool = False) -> DataFrame:
    """External answers as fields: allowed ids, a value, a clamped confidence and a block to show.
    ``answers`` holds doc_id, field_seq, field_id, value, confidence (text) and source."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
        F.col("confidence").try_cast("double"), F.lit(0.75))))
    a = (answers.filter(F.col("field_id").isin(*allowed)
                        & F.col("value").isNotNull() & (tx.strip(F.col("value")) != ""))
         .withColumn("confidence", F.round(conf, 3)).withColumn("value", tx.strip(F.col("value"))))
    where = align_values(a, blocks, ["doc_id", "field_seq"], first_page_first=first_page_first)
    return a.join(where.drop("score", "block_seq"), ["doc_id", "field_seq"]).select(
        "doc_id", "field_seq", "field_id", F.col("field_id").alias("name"), "value", "page", *BOX_COLS,
        "confidence", "source")


ANSWER_OBJECT = "field_id string, name string, value string, confidence string"
FIX_OBJECT = "field_id string, value_ok boolean, suggested_value string, adjusted_confidence string"


def parse_answers(replies: DataFrame, source: str = "gpt") -> DataFrame:
    """Model replies (doc_id, reply) to answer rows."""
    objs = tx.parse_reply_objects(F.col("reply"), ANSWER_OBJECT)
    return (replies.select("doc_id", F.posexplode(objs).alias("field_seq", "o"))
            .select("doc_id", F.col("field_seq").cast("bigint").alias("field_seq"),
                    F.coalesce("o.field_id", "o.name").alias("field_id"), "o.value", "o.confidence",
                    F.lit(source).alias("source")))


def parse_corrections(replies: DataFrame) -> DataFrame:
    objs = tx.parse_reply_objects(F.col("reply"), FIX_OBJECT)
    return (replies.select("doc_id", F.posexplode(objs).alias("seq", "o"))
            .select("doc_id", F.col("seq").cast("bigint").alias("seq"), "o.*"))


def apply_corrections(fields: DataFrame, corrections: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last correction of an id applies to every field with that id: a rejected value is replaced and
    aligned again, an adjusted confidence is clamped, the field is marked as validated."""
    last = (corrections.filter(F.col("field_id").isNotNull() & (F.col("field_id") != ""))
            .groupBy("doc_id", "field_id")
            .agg(F.max_by(F.struct("value_ok", "suggested_value", "adjusted_confidence"), "seq").alias("f")))
    suggestion = F.col("f.suggested_value")
    replaced = F.coalesce(suggestion.isNotNull() & (suggestion != "")
                          & ~F.coalesce(F.col("f.value_ok"), F.lit(True)), F.lit(False))
    changes = last.filter(replaced).select("doc_id", "field_id", tx.strip(suggestion).alias("value"))
    where = align_values(changes, blocks, ["doc_id", "field_id"]).select(
        "doc_id", "field_id", F.struct("page", *BOX_COLS).alias("_at"))
    d = fields.join(last, ["doc_id", "field_id"], "left").join(where, ["doc_id", "field_id"], "left")
    adjusted = F.col("f.adjusted_confidence").try_cast("double")
    new = {
        "value": F.when(replaced, tx.strip(suggestion)).otherwise(F.col("value")),
        "confidence": F.when(adjusted.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted)))
        .otherwise(F.col("confidence")),
        **{c: F.coalesce(F.col(f"_at.{c}"), F.col(c)) for c in ("page", *BOX_COLS)},
    }
    keep = [new.get(c, F.col(c)).alias(c) for c in fields.columns if c != "gpt_validated"]
    return d.select(*keep, F.col("f").isNotNull().alias("gpt_validated"))


# ---- priority, section, state ------------------------------------------------------------------------

# Priorities of the known fields.
KNOWN_PRIORITY = {"policy_number": 1, "full_name": 2, "date_of_birth": 3, "policy_number_alt": 4}


def known_priority(priority: Column, field_id: Column, name: Column) -> Column:
    fid = F.coalesce(field_id, name)
    known = F.lit(99)
    for k, v in KNOWN_PRIORITY.items():
        known = F.when(fid == k, v).otherwise(known)
    return F.coalesce(priority.try_cast("int"), known)


def reading_order_priority(fields: DataFrame) -> DataFrame:
    """1..n from top to bottom inside each document."""
    d = ordered.dense_positions(
        fields, ["doc_id"], {"_p": F.col("page"), "_b": ordered.band_of(F.col("y0"))},
        [F.col("page"), F.col("y0"), F.col("x0"), F.col("field_seq"), F.col("field_id")],
        "_priority", start=1)
    return d.drop("priority").withColumnRenamed("_priority", "priority").withColumn(
        "priority", F.col("priority").cast("int"))


def page_heights(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page").agg(
        F.greatest(F.lit(schema.PAGE_HEIGHT), F.max("y1") * F.lit(1.12)).alias("page_height"))


def section(page: Column, y0: Column, y1: Column, page_height: Column) -> Column:
    h = F.coalesce(page_height, F.lit(schema.PAGE_HEIGHT))
    share = ((y0 + y1) / 2) / h
    band = F.when(share < 0.34, "header").when(share < 0.67, "body").otherwise("footer")
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_"),
                    F.when(y0.isNull() | y1.isNull(), F.lit("unknown")).otherwise(band))


def attach_sections(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    d = fields.drop("section").join(page_heights(blocks), ["doc_id", "page"], "left")
    return d.withColumn("section", section(
        F.col("page"), F.col("y0"), F.col("y1"), F.col("page_height"))).drop("page_height")


def normalise_fields(fields: DataFrame) -> DataFrame:
    """The served shape of a field, with defaults for everything a detector left out."""
    have = set(fields.columns)
    c = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    page = F.coalesce(c("page", "int").try_cast("int"), F.lit(1))
    conf = F.coalesce(c("confidence", "double").try_cast("double"), F.lit(0.0))
    own = section(page, c("y0", "double"), c("y1", "double"), F.lit(schema.PAGE_HEIGHT))
    own = F.when(c("y0", "double").isNull(), F.lit("unknown")).otherwise(own)
    sec = c("section", "string")
    low = conf < 0.7
    return fields.select(
        "doc_id", c("field_seq", "bigint").alias("field_seq"),
        F.coalesce(c("field_id", "string"), c("name", "string")).alias("field_id"),
        F.coalesce(c("name", "string"), c("field_id", "string")).alias("name"),
        c("label", "string").alias("label"), c("value", "string").alias("value"), page.alias("page"),
        *[c(b, "double").alias(b) for b in BOX_COLS], conf.alias("confidence"),
        c("detection", "string").alias("detection"), c("source", "string").alias("source"),
        F.coalesce(c("status", "string"), F.lit("pending")).alias("status"),
        F.coalesce(c("priority", "int").try_cast("int"), F.lit(99)).alias("priority"),
        F.when(sec.isNull() | (sec == ""), own).otherwise(sec).alias("section"),
        low.alias("needs_review"), low.alias("requires_verification"),
        F.coalesce(c("gpt_validated", "boolean"), F.lit(False)).alias("gpt_validated"))


def extract_fields(blocks: DataFrame, *, dynamic: bool = True, answers: Sequence[DataFrame] = (),
                   corrections: DataFrame | None = None, include_placeholders: bool = False,
                   max_standalone: int = STANDALONE_PER_PAGE) -> DataFrame:
    """The whole pipeline: detect, merge accepted external answers in order, correct, prioritise by
    reading order (dynamic mode), attach sections, normalise."""
    found = (detect_fields(blocks, include_placeholders=include_placeholders, max_standalone=max_standalone)
             if dynamic else keyword_fields(blocks))
    for a in answers:
        found = merge_fields(found, accept_answers(a, blocks))
    if corrections is not None:
        found = apply_corrections(found, corrections, blocks)
    if dynamic:
        found = reading_order_priority(stored(found, "fields"))  # read twice: counted, then numbered
    else:
        found = found.withColumn("priority", known_priority(
            F.lit(None).cast("string"), F.col("field_id"), F.col("name")))
    return normalise_fields(attach_sections(found, blocks))
