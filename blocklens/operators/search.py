"""Block search: exact, loose, digits, merged lines, fuzzy.

Queries are a list a caller typed. Each one becomes a set of literal expressions, so one scan of the
blocks serves a whole pass of queries and yields only hits; no pair of block and query is built."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import similarity as sim
from ..functions import text as tx
from ..plans import ordered
from ..plans.stage import materialise, stored
from . import dedupe, layout

QUERIES_PER_PASS = 16
SEGMENT_BLOCKS = 256
BOX_COLS = ("x0", "y0", "x1", "y1")

# Precision order of the match types.
MATCH_RANK = {
    "exact": 0, "exact_loose": 1, "digit_formatted": 2, "line_merged_word": 3, "line": 4,
    "line_nospace": 5, "line_digits": 6, "line_substring": 7, "fuzzy_line": 8,
    "fuzzy_line_tokens": 9, "fuzzy_block": 10,
}
STAGE = {"exact": 1, "exact_loose": 2, "digit_formatted": 3}


@dataclass(frozen=True)
class Query:
    """A query with its derived forms."""

    query_id: int
    raw: str

    @property
    def low(self) -> str:
        return self.raw.lower()

    @property
    def norm(self) -> str:
        return tx.norm_text(self.raw)

    @property
    def nospace(self) -> str:
        return tx.norm_nospace_text(self.raw)

    @property
    def digits(self) -> str:
        return tx.digits_only_text(self.raw)

    @property
    def single_word(self) -> bool:
        return " " not in self.raw


def make_queries(texts: Sequence[str] | str) -> list[Query]:
    """Numbered queries; those without a searchable character find nothing and are left out."""
    items = [texts] if isinstance(texts, str) else list(texts)
    qs = [Query(i, t.strip()) for i, t in enumerate(items) if t and t.strip()]
    return [q for q in qs if q.nospace]


def _passes(qs: Sequence[Query]) -> list[Sequence[Query]]:
    return [qs[i:i + QUERIES_PER_PASS] for i in range(0, len(qs), QUERIES_PER_PASS)]


def _explode(df: DataFrame, keys: Sequence[str], found: Sequence[Column], alias: str = "_h") -> DataFrame:
    """One row per non-null struct of ``found``. Only light structs are exploded; boxes and snippets are
    computed afterwards, on rows that are hits."""
    return (df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias(alias))
            .select(*keys, f"{alias}.*"))


def _stripped(blocks: DataFrame) -> DataFrame:
    t = tx.strip(F.col("text"))
    return (blocks.select("doc_id", "page", "block_seq", t.alias("t"), *BOX_COLS)
            .filter(F.col("t") != ""))


SPAN = "struct<query_id:int,match_type:string,c0:int,c1:int>"
HIT_COLS = ("doc_id", "page", "block_seq", "query_id", *BOX_COLS, "snippet", "source", "match_type")


def _span(q: Query, match_type: str, c0: Column, c1: Column) -> Column:
    return F.struct(F.lit(q.query_id).alias("query_id"), F.lit(match_type).alias("match_type"),
                    c0.alias("c0"), c1.alias("c1")).cast(SPAN)


def _not_stamp(queries: Sequence[Query], text: Column, box: Column) -> Column:
    """False for a hit that is only a page-sized stamp word."""
    ok = F.lit(True)
    for q in queries:
        if q.norm in tx.STAMP_WORDS:
            ok = ok & ~((F.col("query_id") == q.query_id) & geo.stamp_hit(text, box, q.norm))
    return ok


def _place_spans(spans: DataFrame, queries: Sequence[Query], around: int, stamp_text: Column | None = None
                 ) -> DataFrame:
    """Box and snippet of character spans of blocks (columns t, x0..y1, c0, c1)."""
    t, c0, c1 = F.col("t"), F.col("c0"), F.col("c1")
    d = spans.withColumn("_b", geo.slice_box(geo.box_of(), c0, c1, F.length(t)))
    d = d.filter(_not_stamp(queries, t if stamp_text is None else stamp_text, F.col("_b")))
    return d.select("doc_id", "page", "block_seq", "query_id", *[F.col(f"_b.{c}").alias(c) for c in BOX_COLS],
                    tx.snippet(t, c0, c1, around).alias("snippet"), F.lit("ocr").alias("source"), "match_type")


# ---- stages 1 to 3: one block at a time ------------------------------------------------------------

def _block_spans(q: Query, kinds: Sequence[str]) -> Column:
    """Span of the best of the wanted stages in the current block, or null."""
    t, low = F.col("t"), F.col("_low")
    at = F.instr(low, F.lit(q.low)) - 1
    end = at + len(q.raw)
    whole = tx.boundary_ok(t, at, F.lit(len(q.raw)))
    cases = F.when(F.lit(False), F.lit(None).cast(SPAN))
    if "exact" in kinds:
        cases = cases.when((at >= 0) & whole, _span(q, "exact", at, end))
    if "exact_loose" in kinds and len(q.raw) >= 3:
        cases = cases.when((at >= 0) & ~whole, _span(q, "exact_loose", at, end))
    if "digit_formatted" in kinds and len(q.digits) >= 2:
        hit = tx.flexible_digits_span(t, q.digits)
        cases = cases.when(tx.has_flexible_digits(t, q.digits),
                           _span(q, "digit_formatted", hit["c0"], hit["c1"]))
    return cases


def block_stage(blocks: DataFrame, queries: Sequence[Query], kinds: Sequence[str]) -> DataFrame:
    """Hits of the given block stages; a block gives its best stage per query."""
    src = _stripped(blocks).withColumn("_low", F.lower("t"))
    maybe = reduce(Column.__or__, [_maybe(q, kinds) for q in queries])
    spans = _explode(src.filter(maybe), ["doc_id", "page", "block_seq", "t", *BOX_COLS],
                     [_block_spans(q, kinds) for q in queries])
    return _place_spans(spans, queries, 10)


def _maybe(q: Query, kinds: Sequence[str]) -> Column:
    """A cheap test that drops blocks before any span is computed."""
    tests = []
    if {"exact", "exact_loose"} & set(kinds):
        tests.append(F.contains(F.col("_low"), F.lit(q.low)))
    if "digit_formatted" in kinds and len(q.digits) >= 2:
        tests.append(tx.has_flexible_digits(F.col("t"), q.digits))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def search_exact(blocks: DataFrame, texts: Sequence[str] | str) -> DataFrame:
    return _over_passes(texts, lambda qs: block_stage(blocks, qs, ["exact"]))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({tx.WORD}+)"), F.lit(1)))


def search_many(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Whole-word search like ``search_exact`` for a table of any number of queries (query_id, text), in one plan.

    A query that stands on word boundaries has all its words among those of the block. So it is looked up in the
    words' postings by the rarest of its words, and only those blocks are tested. Queries without a word character
    find nothing."""
    src = _stripped(blocks).withColumn("_low", F.lower("t"))
    q = queries.select("query_id", tx.strip(F.col("text")).alias("raw")).withColumn("q_low", F.lower("raw"))
    asked = q.select("query_id", F.explode(_words(F.col("q_low"))).alias("w"))
    at_block = ["doc_id", "page", "block_seq"]
    posts = src.select(*at_block, F.explode(_words(F.col("_low"))).alias("w"))
    counts = posts.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = (asked.join(counts, "w", "left").groupBy("query_id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("k"))
              .filter(F.col("k.n") > 0).select("query_id", F.col("k.w").alias("w")))
    pairs = posts.join(rarest, "w").select(*at_block, "query_id")
    d = src.join(pairs, at_block).join(q, "query_id")
    start, n = F.expr("instr(_low, q_low)") - 1, F.length("raw")
    d = d.filter((start >= 0) & tx.boundary_ok(F.col("t"), start, n))
    spans = d.select("doc_id", "page", "block_seq", "t", *BOX_COLS, F.col("query_id").cast("bigint").alias("query_id"),
                     "raw", F.lit("exact").alias("match_type"), start.cast("int").alias("c0"),
                     (start + n).cast("int").alias("c1"))
    box = geo.slice_box(geo.box_of(), F.col("c0"), F.col("c1"), F.length("t"))
    stamp = reduce(Column.__or__, [(tx._norm_native(F.col("raw")) == w) & geo.stamp_hit(F.col("t"), box, w)
                                   for w in tx.STAMP_WORDS])
    return _place_spans(spans.filter(~stamp), [], 10)


def search_exact_loose(blocks: DataFrame, texts: Sequence[str] | str) -> DataFrame:
    return _over_passes(texts, lambda qs: block_stage(blocks, qs, ["exact_loose"]))


def search_digits(blocks: DataFrame, texts: Sequence[str] | str) -> DataFrame:
    return _over_passes(texts, lambda qs: block_stage(blocks, qs, ["digit_formatted"]))


def _over_passes(texts: Sequence[str] | str, fn: Callable[[Sequence[Query]], DataFrame]) -> DataFrame:
    parts = [fn(p) for p in _passes(make_queries(texts))]
    if not parts:
        raise ValueError("no searchable query")
    return reduce(DataFrame.unionByName, parts)


# ---- stage 4: merged lines -------------------------------------------------------------------------

def merged_lines(blocks: DataFrame, *, y_tol: float = layout.SEARCH_Y_TOL,
                 x_gap: float = layout.SEARCH_X_GAP) -> DataFrame:
    """Blocks on their line with position ``idx`` in it, normalised text ``nt``, the same without blanks
    ``ns`` and raw text ``t``."""
    lined = layout.assign_lines(blocks, y_tol=y_tol, x_gap=x_gap)
    d = tx.with_norm(lined.withColumn("t", tx.strip(F.col("text"))), "t", "nt")
    return d.select(
        "doc_id", "page", "line_start", "block_seq", (F.col("block_seq") - F.col("line_start")).alias("idx"),
        "t", "nt", tx.remove_spaces(F.col("nt")).alias("ns"), *BOX_COLS, "_chunk", "_far")


def line_segments(lined: DataFrame, pos: str, before: int, after: int, payload: Sequence[str],
                  size: int = SEGMENT_BLOCKS, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Lines cut into segments of ``size`` blocks, each with the neighbours a match can reach.

    A line is a chain without a length limit, a match is as long as its query. So a segment needs only
    ``after`` blocks beyond its end, and ``before`` for the character in front of it; no group holds
    more than ``size + before + after`` blocks.

    ``keep(seg, bs)`` drops segments nobody looks at. Those of documents of one chunk are whole in the task that holds
    the chunk, so they are dropped before they travel."""
    n = F.col(pos)
    k = n % size
    own = F.floor(n / size).cast("bigint")
    copies = [own]
    for j in range(-(-after // size)):
        copies.append(F.when((k < after - size * j) & (own > j), own - 1 - j))
    if before:
        copies.append(F.when(k >= size - before, own + 1))
    spread = lined.withColumn("_own", own).withColumn("_seg", F.explode(F.array_compact(F.array(*copies))))
    mine = F.col("_own") == F.col("_seg")
    members = F.sort_array(F.collect_list(F.struct(n.alias("n"), mine.alias("own"), *payload)))
    key = ["doc_id", "page", "line_start", "_seg"]
    counts = [F.count_if(mine).cast("int").alias("_no"), F.count_if(F.col("_own") < F.col("_seg")).cast("int").alias("_nb")]
    if keep is None:
        return spread.groupBy(*key).agg(members.alias("bs"), *counts).filter("_no > 0")
    wanted = keep(F.struct("_seg", "_no"), F.col("bs")) & (F.col("_no") > 0)
    pieces = spread.groupBy("doc_id", "_chunk", *key[1:]).agg(members.alias("bs"), *counts, F.max("_far").alias("_far"))
    whole = pieces.filter(F.col("_far") | wanted).groupBy(*key).agg(
        F.sort_array(F.flatten(F.collect_list("bs"))).alias("bs"), F.sum("_no").cast("int").alias("_no"),
        F.sum("_nb").cast("int").alias("_nb"))
    return whole.filter(wanted)


def _starts(bs: Column, field: str, gap: int) -> Column:
    """Where each member begins in the joined text."""
    return F.aggregate(
        bs, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos")),
        lambda acc, b: F.struct(F.concat(acc["at"], F.array(acc["pos"])).alias("at"),
                                (acc["pos"] + F.length(b[field]) + F.lit(gap)).alias("pos")))["at"]


def _span_parts(bs: Column, starts: Column, field: str, c0: Column, c1: Column) -> Column:
    """The member slices under characters [c0, c1) of the joined text."""
    def part(b: Column, i: Column) -> Column:
        s = F.element_at(starts, i + 1)
        a0 = F.greatest(c0, s) - s
        a1 = F.least(c1, s + F.length(b[field])) - s
        box = geo.box(b["x0"], b["y0"], b["x1"], b["y1"])
        if field == "ds":
            o0, o1 = _digit_pos(b["t"], a0), _digit_pos(b["t"], a1 - 1) + 1
            sliced = geo.slice_box(box, o0, o1, F.length(b["t"]))
        else:
            sliced = geo.slice_box(box, a0, a1, F.length(b[field]))
        return F.when(a1 > a0, sliced)
    return F.filter(F.transform(bs, part), lambda x: x.isNotNull())


def _digit_pos(t: Column, k: Column) -> Column:
    """0-based position of digit number ``k``: what is left after k digits and the non-digits around."""
    head = F.concat(F.lit(r"(?U)^\D*(?:\d\D*){"), k.cast("string"), F.lit("}"))
    return F.length(t) - F.length(F.regexp_replace(t, head, F.lit("")))


def _forms(q: Query) -> dict[str, str]:
    """The rules that apply to a query: phrase on word boundaries, without blanks, digits."""
    f = {}
    if len(q.norm) >= (2 if q.single_word else 1):
        f["nt"] = q.norm
    if len(q.nospace) >= 3:
        f["ns"] = q.nospace
    if len(q.digits) >= 2:
        f["ds"] = q.digits
    return f


# Rules in the order they are tried on a line: joined text, separator, match types (one word, several).
RULES = {"nt": (1, " ", ("line_merged_word", "line")), "ns": (2, "", ("line_nospace",) * 2),
         "ds": (3, "", ("line_digits",) * 2)}
LINE_KEY = ["doc_id", "page", "line_start"]


def _joined(bs: Column, field: str) -> Column:
    return F.array_join(bs.getField(field), RULES[field][1])


def _segments(lined: DataFrame, pos: str, queries: Sequence[Query], fields: Sequence[str]) -> DataFrame:
    """Segments that may match, with the joined text of every rule, and the first ones of lines with more than one.
    Members in front of the own ones (``_nb`` of them) stand first, copies from behind the ``_no`` own ones stand last."""
    reach = max(len(f) for q in queries for f in _forms(q).values()) + 1
    cols = list(dict.fromkeys([*fields, "nt", "t", *BOX_COLS]))

    def keep(seg: Column, bs: Column) -> Column:
        return ((seg["_seg"] == 0) & (F.size(bs) != seg["_no"])) | _may_match(queries, fields, bs)

    s = stored(line_segments(lined, pos, 1, reach, cols, keep=keep), "segments")
    bs = F.col("bs")
    s = s.withColumns({f"_t_{f}": _joined(bs, f) for f in fields})
    return s.withColumn("_whole", (F.col("_seg") == 0) & (F.size(bs) == F.col("_no")))


def _may_match(queries: Sequence[Query], fields: Sequence[str], bs: Column) -> Column:
    """A phrase is also there without its blanks, so one text is enough for most queries."""
    wanted: dict[str, list[str]] = {}
    for q in queries:
        forms = {f: v for f, v in _forms(q).items() if f in fields}
        if "nt" in forms and "ns" in forms:
            del forms["nt"]
        for f, v in forms.items():
            wanted.setdefault(f, []).append(v)

    def any_of(f: str, values: list[str]) -> Column:
        # One-element array: the text is joined once and bound by the lambda.
        return F.exists(F.array(_joined(bs, f)), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(v)) for v in values]))

    return reduce(Column.__or__, [any_of(f, v) for f, v in wanted.items()], F.lit(False))


def _rule_spans(segs: DataFrame, queries: Sequence[Query], fields: Sequence[str], digits_ok: Column
                ) -> DataFrame:
    """First match of each query and rule in each segment, if it begins in the segment's own blocks.

    The phrase rule takes the first match on word boundaries. The other two look only at the first
    occurrence of a line: when it is off the boundary it still blocks later ones, so it is kept with
    ``ok`` false."""
    bs, nb, no = F.col("bs"), F.col("_nb"), F.col("_no")
    bounds = {}
    for f in fields:
        st = F.col(f"_s_{f}")
        bounds[f"_lo_{f}"] = F.element_at(st, nb + 1)
        bounds[f"_hi_{f}"] = F.element_at(st, nb + no) + F.length(F.element_at(bs, nb + no)[f])
    d = segs.withColumns({f"_s_{f}": _starts(bs, f, len(RULES[f][1])) for f in fields}).withColumns(bounds)
    found = []
    for q in queries:
        for f, v in _forms(q).items():
            if f not in fields:
                continue
            txt, lo = F.col(f"_t_{f}"), F.col(f"_lo_{f}")
            # A phrase cannot begin before the own blocks of a segment without being cut by their edge.
            at = (_first_phrase_from(txt, v, lo) if f == "nt" else
                  F.nullif(F.call_function("locate", F.lit(v), txt, lo + 1) - 1, F.lit(-1)))
            ok = F.contains(txt, F.lit(v)) & (digits_ok if f == "ds" else F.lit(True))
            found.append(F.when(ok, F.struct(
                F.lit(q.query_id).alias("query_id"), F.lit(RULES[f][0]).alias("kind"),
                F.lit(RULES[f][2][0 if q.single_word else 1]).alias("match_type"),
                at.alias("at"), F.lit(len(v)).alias("n")).cast(
                    "struct<query_id:int,kind:int,match_type:string,at:int,n:int>")))
    keep = [*LINE_KEY, "_seg", "bs", *[f"{p}_{f}" for f in fields for p in ("_t", "_s", "_lo", "_hi")]]
    spans = _explode(d, keep, found)
    at, n, kind = F.col("at"), F.col("n"), F.col("kind")

    def of(p: str) -> Column:
        c = F.col(f"{p}_{fields[0]}")
        for f in fields[1:]:
            c = F.when(kind == RULES[f][0], F.col(f"{p}_{f}")).otherwise(c)
        return c

    spans = spans.withColumns({"_txt": of("_t"), "_st": of("_s")}).filter(
        at.isNotNull() & (at >= of("_lo")) & (at < of("_hi")))
    parts, ok = None, F.lit(True)
    for f in fields:
        k = kind == RULES[f][0]
        p = _span_parts(bs, F.col("_st"), f, at, at + n)
        parts = p if parts is None else F.when(k, p).otherwise(parts)
        if f == "ns":
            ok = F.when(k, tx.boundary_ok(F.col("_txt"), at, n)).otherwise(ok)
        if f == "ds":
            ok = F.when(k, _digit_edges_ok(bs, F.col("_st"), at, n)).otherwise(ok)
    boxes = spans.withColumn("_parts", parts).withColumn("_b", geo.union_box(F.col("_parts")))
    # A stamp alone on its line: such a line is shorter than one segment.
    raw = F.array_join(bs.getField("t"), " ")
    ok = ok & ((F.col("_seg") > 0) | (kind == 3) | _not_stamp(queries, raw, F.col("_b")))
    head = F.substring(F.array_join(F.slice(bs, 1, 120).getField("nt"), " "), 1, 120)
    return boxes.select(
        *LINE_KEY, "query_id", "kind", (F.col("_seg") * F.lit(1 << 32) + at).cast("bigint").alias("pos"),
        "match_type", ok.alias("ok"), *[F.col(f"_b.{c}").alias(c) for c in BOX_COLS],
        F.when(F.col("_seg") == 0, head).alias("head"))


def _first_phrase_from(text: Column, q: str, lo: Column) -> Column:
    """First occurrence on word boundaries at or after ``lo``, where a block begins."""
    at = tx.first_phrase_index(F.substring(text, lo + 1, F.length(text)), q)
    return at + lo


def _digit_edges_ok(bs: Column, starts: Column, at: Column, n: Column) -> Column:
    """The characters around the match in the blocks it begins and ends in are not digits."""
    def holder(p: Column) -> Column:
        return F.filter(F.transform(bs, lambda b, i: F.struct(
            b["t"].alias("t"), (p - F.element_at(starts, i + 1)).alias("k"), F.length(b["ds"]).alias("n"))),
            lambda h: (h["k"] >= 0) & (h["k"] < h["n"]))[0]
    first, last = holder(at), holder(at + n - 1)
    before = tx.char_at(first["t"], _digit_pos(first["t"], first["k"]) - 1)
    after = tx.char_at(last["t"], _digit_pos(last["t"], last["k"]) + 1)
    return ~tx.is_digit_char(before) & ~tx.is_digit_char(after)


def _head_rows(segs: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """Head text of lines longer than one segment, for hits further on."""
    head = F.substring(F.array_join(F.slice("bs", 1, 120).getField("nt"), " "), 1, 120)
    long = segs.filter((F.col("_seg") == 0) & ~F.col("_whole"))
    ids = F.array(*[F.lit(q.query_id) for q in queries])
    return long.select(*LINE_KEY, F.explode(ids).alias("query_id"), head.alias("head"))


def line_stage(blocks: DataFrame, queries: Sequence[Query], *, y_tol: float = layout.SEARCH_Y_TOL,
               x_gap: float = layout.SEARCH_X_GAP) -> DataFrame:
    """Merged-line hits: the phrase on word boundaries, else without blanks, else its digits. At most
    one hit per line and query.

    All rules share one pass over the segments. Digits may lie far apart on a line, so lines longer than a
    segment take the digit rule over their digit-bearing blocks alone."""
    qs = [q for q in queries if _forms(q)]
    fields = [f for f in RULES if any(f in _forms(q) for q in qs)]
    lined = merged_lines(blocks, y_tol=y_tol, x_gap=x_gap)
    if "ds" in fields:
        lined = lined.withColumn("ds", tx.digits_only(F.col("t")))
    segs = _segments(lined, "idx", qs, fields)
    found = [_rule_spans(segs.filter(_may_match(qs, fields, F.col("bs"))), qs, fields, F.col("_whole")),
             _head_rows(segs, qs)]
    numeric = [q for q in qs if "ds" in _forms(q)]
    if numeric:
        long = lined.filter(F.col("idx") >= SEGMENT_BLOCKS).select(*LINE_KEY).distinct()
        d = lined.filter(F.col("ds") != "").join(long, LINE_KEY, "left_semi")
        d = ordered.dense_positions(d, LINE_KEY, {"_c": ordered.chunk_of(F.col("block_seq"))},
                                    [F.col("block_seq")], "digit_pos")
        far = _segments(d, "digit_pos", numeric, ["ds"])
        found.append(_rule_spans(far.filter(_may_match(numeric, ["ds"], F.col("bs"))), numeric, ["ds"], F.lit(True))
                     .withColumn("head", F.lit(None).cast("string")))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)
    row = F.struct("pos", "match_type", "ok", *BOX_COLS)
    firsts = rows.groupBy(*LINE_KEY, "query_id").agg(
        F.max("head").alias("head"),
        *[F.min(F.when(F.col("kind") == k, row)).alias(f"k{k}") for k in (1, 2, 3)])
    pick = F.coalesce(*[F.when(F.col(f"k{k}.ok"), F.col(f"k{k}")) for k in (1, 2, 3)])
    hits = firsts.withColumn("b", pick).filter(F.col("b").isNotNull())
    return hits.select(
        "doc_id", "page", F.col("line_start").alias("block_seq"), "query_id",
        *[F.col(f"b.{c}").alias(c) for c in BOX_COLS], F.col("head").alias("snippet"),
        F.lit("ocr").alias("source"), F.col("b.match_type").alias("match_type"))


def search_lines(blocks: DataFrame, texts: Sequence[str] | str, **kw) -> DataFrame:
    return _over_passes(texts, lambda qs: line_stage(blocks, qs, **kw))


# ---- stage 5: fuzzy --------------------------------------------------------------------------------

_WORD_EDGE = rf"(?<={tx.WORD})(?!{tx.WORD})|(?<!{tx.WORD})(?={tx.WORD})"
_MARK = "\x01"


def fuzzy_stage(blocks: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """One word: the first close token of a block. Several words: the token sets of the whole block."""
    src = _stripped(blocks).filter(F.length("t") >= 2)
    single = [q for q in queries if q.single_word and len(q.norm) >= 3]
    multi = [q for q in queries if not q.single_word and len(q.norm) >= 3]
    keys = ["doc_id", "page", "block_seq", "t", *BOX_COLS]
    parts = []
    if single:
        d = src.withColumn("_ps", F.split("t", _WORD_EDGE))
        # The mark itself may stand in a text: another control character takes its place there.
        pieces = F.when(F.contains("t", F.lit(_MARK)), F.split(F.translate("t", _MARK, "\x02"), _WORD_EDGE)).otherwise(
            F.col("_ps"))
        d = tx.with_norm(d.withColumn("_pj", F.array_join(pieces, _MARK)), "_pj", "_pn")
        d = d.withColumn("_pn", F.split("_pn", _MARK))
        spans = _explode(d, keys, [_token_span(q) for q in single])
        parts.append(_place_spans(spans, single, 8, F.substring(F.col("t"), F.col("c0") + 1,
                                                                F.col("c1") - F.col("c0"))))
    if multi:
        d = tx.with_norm(src, "t", "nt")
        spans = _explode(d, keys, [_token_set_span(q) for q in multi])
        parts.append(spans.select(
            "doc_id", "page", "block_seq", "query_id", *BOX_COLS, F.substring("t", 1, 120).alias("snippet"),
            F.lit("ocr").alias("source"), "match_type"))
    if not parts:
        parts.append(_place_spans(_explode(src, keys, [F.lit(None).cast(SPAN)]), [], 8))
    return reduce(DataFrame.unionByName, parts)


def _token_span(q: Query) -> Column:
    qn = q.norm
    need = sim.block_thresholds(q.raw, qn)[1]
    ps, pn, letters = F.col("_ps"), F.col("_pn"), "".join(sorted(set(qn)))
    delta = sim.max_length_delta(len(qn))

    def close(p: Column, i: Column) -> Column:
        n = F.length(p)
        # A common subsequence holds only characters of the query.
        shared = n - F.length(F.translate(p, letters, ""))
        ok = (n >= 2) & (F.abs(n - len(qn)) <= delta) & (
            F.least(shared, F.lit(len(qn))) * 200 >= (need - 1e-6) * (n + len(qn))) & tx.is_word_char(F.substring(p, 1, 1))
        return F.when(F.when(ok, sim.ratio(p, qn)) >= need, i)

    first = F.get(F.filter(F.transform(pn, close), lambda x: x.isNotNull()), F.lit(0))

    def span(i: Column) -> Column:
        c0 = F.length(F.array_join(F.slice(ps, F.lit(1), i), ""))
        return _span(q, "fuzzy_block", c0, c0 + F.length(F.element_at(ps, i + 1)))

    # One-element array: the position is computed once and bound by the lambda.
    return F.get(F.transform(F.filter(F.array(first), lambda x: x.isNotNull()), span), F.lit(0))


def _token_set_span(q: Query) -> Column:
    need = max(sim.block_thresholds(q.raw, q.norm)[1] - 2, 78)
    gate = F.lit(True)
    if len(q.nospace) >= 6:
        gate = F.contains(tx.remove_spaces(F.col("nt")), F.lit(q.nospace))
    score = sim.token_set_ratio(F.when(gate, F.col("nt")), q.norm)
    return F.when(F.coalesce(score >= need, F.lit(False)),
                  _span(q, "fuzzy_block", F.lit(0), F.length("t")))


def search_fuzzy(blocks: DataFrame, texts: Sequence[str] | str) -> DataFrame:
    return _over_passes(texts, lambda qs: fuzzy_stage(blocks, qs))


# ---- stand-alone scores of lines (outside the cascade) -----------------------------------------------

def score_lines(lines: DataFrame, text: str) -> DataFrame:
    """Partial and token-sort score of every line against a phrase, and whether the line would count."""
    q = make_queries(text)[0]
    need = sim.line_threshold(q.raw, q.norm)
    d = tx.with_norm(lines, "text", "norm")
    d = d.withColumn("partial", sim.partial_ratio(F.col("norm"), q.norm)).withColumn(
        "token_sort", sim.token_sort_ratio(F.col("norm"), q.norm))
    ns_hit = F.contains(tx.remove_spaces(F.col("norm")), F.lit(q.nospace))
    ok = (F.col("partial") >= need) | ((F.col("token_sort") >= 86) & (F.lit(q.single_word) | ns_hit))
    if not q.single_word and len(q.nospace) >= 6:
        ok = ok & ns_hit
    return d.withColumn("match_type", F.when(ok, F.when(F.col("partial") >= need, "fuzzy_line")
                                             .otherwise("fuzzy_line_tokens")))


def best_block_per_line(lined: DataFrame, text: str) -> DataFrame:
    """The block of each line that fits best, where one reaches the block thresholds."""
    q = make_queries(text)[0]
    p_need, r_need = sim.block_thresholds(q.raw, q.norm)
    d = tx.with_norm(lined.withColumn("t", tx.strip(F.col("text"))).filter(F.length("t") >= 2), "t", "nt")
    d = d.filter(F.col("nt") != "").withColumn("_p", sim.partial_ratio(F.col("nt"), q.norm)).withColumn(
        "_r", sim.ratio(F.col("nt"), q.norm))
    d = d.filter((F.col("_p") >= p_need) | (F.col("_r") >= r_need))
    best = d.groupBy("doc_id", "page", "line_start").agg(F.min(F.struct(
        (-F.greatest("_p", "_r")).alias("k"), "block_seq", *BOX_COLS,
        F.substring("t", 1, 120).alias("text"))).alias("b"))
    return best.select("doc_id", "page", "line_start", F.col("b.block_seq").alias("block_seq"),
                       *[F.col(f"b.{c}").alias(c) for c in BOX_COLS], F.col("b.text").alias("text"),
                       (-F.col("b.k")).alias("score"))


# ---- the cascade -------------------------------------------------------------------------------------

def search_blocks(blocks: DataFrame, texts: Sequence[str] | str, *,
                  y_tol: float = layout.SEARCH_Y_TOL, x_gap: float = layout.SEARCH_X_GAP) -> DataFrame:
    """Positioned hits. For every document and query the first stage with a hit decides; later, dearer
    stages read only documents some query is still open for."""
    return _over_passes(texts, lambda qs: _cascade(blocks, qs, y_tol, x_gap))


def _stage_no() -> Column:
    c = F.lit(0)
    for k, v in STAGE.items():
        c = F.when(F.col("match_type") == k, v).otherwise(c)
    return c


def _cascade(blocks: DataFrame, qs: Sequence[Query], y_tol: float, x_gap: float) -> DataFrame:
    out_cols = ["doc_id", "query_id", "page", *BOX_COLS, "snippet", "source", "match_type"]
    pair = ["doc_id", "query_id"]
    # Copies of a hit collapse by grid key before anything is kept; the rest is small next to the blocks.
    raw = block_stage(blocks, qs, ["exact", "exact_loose", "digit_formatted"]).withColumn("stage_no", _stage_no())
    local = materialise(dedupe.first_per_key(
        raw, ["doc_id", "page", "query_id", "stage_no"], dedupe.grid_keys(8.0),
        ["block_seq", *BOX_COLS]))
    best = local.groupBy(*pair).agg(F.min("stage_no").alias("stage_no"))
    first = local.join(best, [*pair, "stage_no"], "left_semi")

    def still_open(done: DataFrame) -> DataFrame:
        """Blocks of documents that some query has not settled."""
        full = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(qs))
        return blocks.join(full.select("doc_id"), "doc_id", "left_anti")

    done = best.select(*pair)
    lines = materialise(line_stage(still_open(done), qs, y_tol=y_tol, x_gap=x_gap).join(done, pair, "left_anti"))
    done = done.unionByName(lines.select(*pair).distinct())
    fuzzy = materialise(fuzzy_stage(still_open(done), qs).join(done, pair, "left_anti"))
    hits = first.select(*HIT_COLS).unionByName(lines.select(*HIT_COLS)).unionByName(fuzzy.select(*HIT_COLS))
    return dedupe.ocr_hits(hits, MATCH_RANK).select(*out_cols)


def with_filename(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return hits.join(documents.select("doc_id", "filename"), "doc_id")
