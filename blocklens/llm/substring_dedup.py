"""Removal of repeated byte strings, found in a distributed suffix order.

Texts are cut at anchors: positions whose 16 bytes have the smallest hash in some window of ``WINDOW`` positions (the
last of equal ones). An anchor depends on the bytes around it only, so equal strings have equal anchors inside, at
most ``WINDOW`` bytes apart, and every string of ``LENGTH`` bytes has one whose surroundings, ``LEFT`` bytes before and
``RIGHT`` after, lie in the string. Only anchors whose surroundings occur twice can belong to a repeated string; the
others leave. What stays of a text are runs of neighbouring anchors, and equal runs are one.

The runs, as sequences of symbols (surroundings and distance to the next anchor), are put in suffix order by the
difference-cover method of :mod:`suffix_array`; adjacent suffixes are compared. Where one agrees with a neighbour as
far as the strings of its anchor reach, all these strings are repeated. Strings at the border of a repeat, whose
anchor's symbols differ further out, are compared byte by byte (128-bit hashes): each distinct one of an anchor that
also occurs with other symbols, once for each class of equal symbols. That check is exact, so the result is: no string
is missed and none is removed by sampling. Texts are told apart by a 64-bit hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import stored, utf8_text
from blocklens.llm.suffix_array import suffix_ranks

LENGTH = 400
GRAM, WINDOW = 16, 128
LEFT, RIGHT = WINDOW - 1, GRAM + WINDOW - 1
#: An anchor's strings begin up to the anchor before it less LEFT, so they end at most so far behind it.
REACH = LENGTH - LEFT
_BITS, _PIECE, _OVERLAP = 22, 1 << 21, 1 << 9


def _hashed(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    x = data.astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x = x[:-step] | (x[step:] << np.uint64(bits))
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (x[8:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: bytes) -> np.ndarray:
    """Positions that are the smallest, of equal ones the last, of any window inside ``data``."""
    found = []
    for at in range(0, max(len(data) - _OVERLAP, 1), _PIECE):
        part = np.frombuffer(data[at:at + _PIECE + _OVERLAP], np.uint8)
        if len(part) < GRAM + WINDOW - 1:
            continue
        low = np.uint64((1 << _BITS) - 1)
        h = _hashed(part)
        h = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        step = 1
        while step < WINDOW:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        position = (low - (h & low)).astype(np.int64)
        found.append(position[np.r_[True, np.diff(position) != 0]] + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


_ANCHORS = pa.schema([("tid", pa.int64()), ("a", pa.list_(pa.int32())), ("k", pa.list_(pa.int64()))])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text of LENGTH bytes or more, with the hash of their surroundings."""
    digest = xxhash.xxh64_intdigest

    def rows(tids, texts):
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        data = b"".join(texts)  # anchors that a neighbouring text sways lie too near the border to be used
        at = anchors(data)
        own = np.searchsorted(ends, at, "right")
        fine = (at - LEFT >= starts[own]) & (at + RIGHT <= ends[own]) if len(at) else np.zeros(0, bool)
        at, own = at[fine], own[fine]
        view = memoryview(data)
        keys = np.array([digest(view[x - LEFT:x + RIGHT]) for x in at.tolist()], np.uint64).astype(np.int64)
        bounds = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
        out = [(t, (at[a:b] - s).astype(np.int32), keys[a:b])
               for t, s, a, b in zip(tids, starts.tolist(), bounds, bounds[1:]) if b > a]
        return pa.RecordBatch.from_pydict(dict(zip(_ANCHORS.names, zip(*out))), schema=_ANCHORS) if out else None

    for batch in batches:
        tids, texts, size = [], [], 0
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tids.append(tid)
            texts.append(text.encode())
            size += len(texts[-1])
            if size >= 1 << 20:
                if (made := rows(tids, texts)) is not None:
                    yield made
                tids, texts, size = [], [], 0
        if texts and (made := rows(tids, texts)) is not None:
            yield made


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of neighbouring anchors of each text. ``back`` and ``gap`` are the distances to the anchors around the
    run (-1 if there is none)."""
    for frame in frames:
        out = []
        for tid, anchors_ in zip(frame["tid"], frame["anchors"]):
            part = pd.DataFrame(list(anchors_), columns=["i", "a", "k", "back", "gap"])
            i = part["i"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), len(i)]
            for s, e in zip(cuts, cuts[1:]):
                a, k = part["a"].to_numpy(np.int32)[s:e], part["k"].to_numpy(np.int64)[s:e]
                gap = int(part["gap"].iloc[e - 1])
                low, high = np.frombuffer(xxhash.xxh3_128_digest(k.tobytes() + np.diff(a).tobytes()
                                                                 + gap.to_bytes(4, "little", signed=True)), np.int64)
                out.append((tid, int(low), int(high), int(a[0]), int(part["back"].iloc[s]), gap,
                            np.diff(a, prepend=a[0]).cumsum().astype(np.int32), k))
        yield pd.DataFrame(out, columns=["tid", "r1", "r2", "start", "back", "gap", "rel", "k"])


def _symbols(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each anchor of a run: its symbol, and for the anchor after it the hash of the symbols that its
    strings' bytes span (null where they reach out of the run) and their number."""
    for frame in frames:
        out = {"seq": [], "pos": [], "name": [], "k": [], "span": [], "need": []}
        for seq, gap, rel, k in zip(frame["seq"], frame["gap"], frame["rel"], frame["k"]):
            rel, k = np.asarray(rel, np.int64), np.asarray(k, np.int64)
            gaps = np.append(np.diff(rel), gap)
            name = (k ^ (gaps * np.int64(0x5851F42D4C957F2D))).astype(np.uint64)
            name = ((name ^ (name >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) & np.uint64((1 << 62) - 1)).astype(np.int64) + 1
            last = np.searchsorted(rel, rel[1:] + REACH - RIGHT)  # first anchor whose surroundings cover the reach
            data = name.tobytes()
            span = [xxhash.xxh64_intdigest(data[8 * p:8 * (j + 1)]) >> 1 if j < len(rel) else None
                    for p, j in enumerate(last.tolist())]
            out["seq"].append(np.full(len(rel), seq, np.int64))
            out["pos"].append(np.arange(len(rel)))
            out["name"].append(name)
            out["k"].append(k)
            out["span"] += [*span, None]
            out["need"].append(np.append(last - np.arange(len(last)) + 1, 0))
        yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "span" else np.concatenate(v) if v else []
                            for c, v in out.items()})


_NEIGHBOURS = "seq bigint, pos bigint, span bigint, before boolean, again boolean, task bigint, row bigint"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a row's span is that of the row before (``before``) or of either neighbour (``again``)."""
    task, done, held = TaskContext.get().partitionId(), 0, None

    def flagged(table: pd.DataFrame, first: int, lead: int, tail: int) -> pa.RecordBatch:
        span = table["span"].astype("Int64")
        same = ((span == span.shift(1)) & span.notna()).fillna(False).to_numpy(bool)
        nxt = np.append(same[1:], False)
        out = pd.DataFrame({"seq": table["seq"], "pos": table["pos"], "span": span, "before": same, "again": same | nxt,
                            "task": task, "row": np.arange(first, first + len(table))})
        return pa.RecordBatch.from_pandas(out.iloc[lead:len(out) - tail], preserve_index=False)

    for batch in batches:  # each batch is judged with the last two rows of the one before
        table = batch.to_pandas()
        if not len(table):
            continue
        joined = table if held is None else pd.concat([held, table], ignore_index=True)
        lead = 0 if held is None else len(held) - 1
        yield flagged(joined, done - (0 if held is None else len(held)), lead, 1)
        done += len(table)
        held = joined.iloc[-2:]
    if held is not None:
        yield flagged(held.reset_index(drop=True), done - len(held), len(held) - 1, 0)


def _neighbours(rows: DataFrame) -> DataFrame:
    """``seq, pos, before, again`` of rows in the order of ``rank``."""
    spark = rows.sparkSession
    ordered = rows.select("rank", "seq", "pos", "span").repartitionByRange("rank", "seq", "pos").sortWithinPartitions(
        "rank", "seq", "pos").select("seq", "pos", "span")
    flags = stored(ordered.mapInArrow(_adjacent, _NEIGHBOURS), "adjacent")
    edges = flags.groupBy("task").agg(F.min("row").alias("lo"), F.max("row").alias("hi"),
                                      F.min_by("span", "row").alias("first"), F.max_by("span", "row").alias("last"))
    edges = sorted(edges.collect(), key=lambda r: r["task"])  # a row a partition
    fixes = []
    for left, right in zip(edges, edges[1:]):
        if left["last"] is not None and left["last"] == right["first"]:
            fixes += [(left["task"], left["hi"], False), (right["task"], right["lo"], True)]
    fixes = spark.createDataFrame(fixes, "task bigint, row bigint, follows boolean").groupBy("task", "row").agg(
        F.bool_or("follows").alias("follows"))
    return flags.join(F.broadcast(fixes), ["task", "row"], "left").select(
        "seq", "pos", (F.col("before") | F.coalesce("follows", F.lit(False))).alias("before"),
        (F.col("again") | F.col("follows").isNotNull()).alias("again"))


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a text's run: byte spans that are repeated, and ranges of string starts that are to be compared."""
    for frame in frames:
        spans, starts = [], []
        for row in frame.itertuples(index=False):
            at = np.asarray(row.rel, np.int64) + row.start
            state = np.asarray([s["state"] for s in sorted(row.states, key=lambda s: s["pos"])])
            before = np.append(at[0] - row.back if row.back >= 0 else LEFT - 1, at[:-1])
            low, high = before - LEFT + 1, at - LEFT  # first and last string start of each anchor
            known = state & 1 > 0
            spans.append(list(zip(low[known].tolist(), (high[known] + LENGTH).tolist())))
            asked = (state & 4 > 0) | ((state & 2 > 0) & bool(row.chosen))
            starts.append(list(zip(low[asked].tolist(), high[asked].tolist())))
        yield pd.DataFrame({"tid": frame["tid"], "spans": spans, "starts": starts})


_RANGES = "array<struct<lo:int,hi:int>>"
_HASHES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("tid", pa.int64()), ("p", pa.int32())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for tid, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            view = memoryview(text.encode())
            at = np.unique(np.concatenate([np.arange(max(r["lo"], 0), min(r["hi"], len(view) - LENGTH) + 1)
                                           for r in ranges] or [np.zeros(0, np.int64)])).astype(np.int32)
            if len(at):
                both = np.frombuffer(b"".join([digest(view[p:p + LENGTH]) for p in at.tolist()]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[::2]), pa.array(both[1::2]),
                                                  pa.array(np.full(len(at), tid, np.int64)), pa.array(at)], schema=_HASHES)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal spans of a union; touching ones are one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > end[:-1]]
    return np.stack([spans[new, 0], end[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        removed, digests = [], []
        for row in frame.itertuples(index=False):
            data = row.text.encode()
            if row.copies > 1:
                spans = np.array([[0, len(data)]])
            else:
                known = [(s["lo"], s["hi"]) for s in row.spans]
                single = [(p, p + LENGTH) for p in (row.starts if row.starts is not None else ())]
                spans = merged(np.array(known + single, np.int64).reshape(-1, 2))
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed.append([tuple(s) for s in spans.tolist()])
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pd.DataFrame({"tid": frame["tid"], "removed": removed, "kept_sha256": digests})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, removed, kept_sha256``, one row for each row of ``docs``.

    ``removed`` lists the maximal spans (lo, hi) of UTF-8 bytes that lie in a string of ``LENGTH`` bytes which also
    starts elsewhere, in any row, overlaps included; ``kept_sha256`` hashes the bytes outside. Null counts as empty.
    Rows that repeat an id, or have none, are texts like others. Other columns are ignored; an empty table gives an
    empty result."""
    texts = docs.select(F.col(id_col).alias("_id"), utf8_text(text_col).cast("string").alias("text"))
    texts = texts.select("_id", F.xxhash64("text").alias("tid"), F.octet_length("text").alias("n"), "text")
    long_ = texts.where(F.col("n") >= LENGTH).select("tid", "text")
    found = stored(long_.mapInArrow(_anchored, "tid bigint, a array<int>, k array<bigint>"), "anchors")

    twice = found.select(F.explode("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    each = found.select("tid", "a", F.posexplode("k").alias("i", "k")).select(
        "tid", "i", F.get("a", F.col("i")).alias("at"), "k",
        F.coalesce(F.get("a", F.col("i")) - F.when(F.col("i") > 0, F.get("a", F.col("i") - 1)), F.lit(-1)).alias("back"),
        F.coalesce(F.get("a", F.col("i") + 1) - F.get("a", F.col("i")), F.lit(-1)).alias("gap"))
    each = stored(each.join(twice.select("k"), "k", "left_semi"), "candidates")
    by_text = each.groupBy("tid").agg(F.array_sort(F.collect_set(
        F.struct("i", F.col("at").alias("a"), "k", "back", "gap"))).alias("anchors"))
    runs = stored(by_text.mapInPandas(_runs, "tid bigint, r1 bigint, r2 bigint, start int, back int, gap int, "
                                             "rel array<int>, k array<bigint>"), "runs")
    distinct = runs.groupBy("r1", "r2").agg(
        F.min(F.struct("tid", "start")).alias("chosen"), F.count(F.lit(1)).alias("copies"), F.first("gap").alias("gap"),
        F.first("rel").alias("rel"), F.first("k").alias("k"))
    distinct = stored(distinct.withColumn("seq", F.monotonically_increasing_id()), "distinct")

    symbols = stored(distinct.select("seq", "gap", "rel", "k").mapInPandas(
        _symbols, "seq bigint, pos bigint, name bigint, k bigint, span bigint, need bigint"), "names")
    depth = symbols.agg(F.max("need")).first()[0] or 1
    ranks = suffix_ranks(symbols.select("seq", "pos", "name"), depth)
    flags = _neighbours(ranks.join(symbols.where("span IS NOT NULL"), ["seq", "pos"]))
    # The flags of a suffix hold for the strings of the anchor after its first.
    judged = symbols.select("seq", "pos", "k").join(
        flags.select("seq", (F.col("pos") + 1).alias("pos"), "before", "again"), ["seq", "pos"], "left")
    spans = symbols.select("seq", (F.col("pos") + 1).alias("pos"), "span").where("span IS NOT NULL")
    judged = stored(judged.join(spans, ["seq", "pos"], "left"), "judged")
    mixed = judged.groupBy("k").agg((F.count_if(F.col("span").isNull()) > 0).alias("open"),
                                    F.min("span").alias("low"), F.max("span").alias("high"))
    mixed = mixed.select("k", (F.col("open") | (F.col("low") < F.col("high"))).alias("mixed"))
    states = judged.join(mixed, "k").join(distinct.select("seq", "copies"), "seq")
    whole = F.col("span").isNotNull()
    state = (F.when(whole & (F.col("again") | (F.col("copies") > 1)), 1).otherwise(0)
             + F.when(whole & F.col("mixed") & ~F.col("before"), 2).otherwise(0) + F.when(whole, 0).otherwise(4))
    states = states.groupBy("seq").agg(F.collect_list(F.struct(F.col("pos"), state.alias("state"))).alias("states"))
    states = distinct.select("seq", "r1", "r2", F.col("chosen.tid").alias("own"), F.col("chosen.start").alias("own_start")
                             ).join(states, "seq")
    parts = runs.join(states, ["r1", "r2"]).select(
        "tid", "start", "back", "rel", "states",
        ((F.col("tid") == F.col("own")) & (F.col("start") == F.col("own_start"))).alias("chosen"))
    parts = parts.mapInPandas(_judged, f"tid bigint, spans {_RANGES}, starts {_RANGES}")
    parts = parts.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                     F.flatten(F.collect_list("starts")).alias("asked"))

    distinct_texts = long_.groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    held = stored(distinct_texts.join(parts, "tid"), "held")
    asked = held.where(F.size("asked") > 0).select("tid", "text", "asked")
    strings = asked.mapInArrow(_strings, "h1 bigint, h2 bigint, tid bigint, p int")
    again = stored(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"), "again")
    starts = strings.join(again, ["h1", "h2"], "left_semi").groupBy("tid").agg(F.collect_list("p").alias("starts"))
    cut = held.select("tid", "text", "copies", "spans").join(starts, "tid", "left").mapInPandas(
        _cut, f"tid bigint, removed {_RANGES}, kept_sha256 string")
    cut = stored(cut.where(F.size("removed") > 0), "cut")

    rows = texts.select("_id", "tid", "n", F.sha2("text", 256).alias("_whole"))
    return rows.join(cut, "tid", "left").select(
        F.col("_id").alias(id_col), F.col("n").cast("bigint").alias("n_bytes"),
        F.coalesce("removed", F.expr(f"CAST(array() AS {_RANGES})")).alias("removed"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))
