"""Line dedup on levelled sorted runs of line hashes.

Every line that may count is hashed once (128 bits) and stored with its row and position. Keys found in at least
``min_docs`` documents are the candidates. The documents then come in batches, largest ids first: a batch reduces to
its largest holder of each candidate key, merge-anti-joins these sorted keys with the runs, and what no run holds
becomes a new sorted run of level 0. When a level has ``fanout`` runs, they are compacted into one run of the next
level. The runs together name, for each candidate key, the one document that keeps its lines.

A line in a third of all documents is pre-aggregated before it is shuffled, and the joins have one row a key on one
side. Positions to drop go back to the texts, which are cut into slices: linear in the length of a text. DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import row_key, stored, utf8_text

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare))  # ASCII: the fast form does the same
            .otherwise(F.translate(bare, upper, lower)))


def lines_of(text_col: str) -> Column:
    return F.split(utf8_text(text_col), "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``_id, _row, _pos, _h1, _h2`` of the lines whose key has ``min_chars`` code points."""
    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                       F.posexplode(lines_of(text_col)).alias("_pos", "_line")).where(F.col("_id").isNotNull())
    rows = rows.where(F.char_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line")))
    return rows.where(F.char_length("_key") >= min_chars).select(
        "_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), F.col("_key")).alias("_h2"))


class LineRuns:
    """Levelled sorted runs of (``_h1, _h2, _holder``); a key lies in one run only."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Keys of ``batch`` that no run holds become a run; full levels are compacted."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), ["_h1", "_h2"], "left_anti")
        self._put(batch, 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        run = stored(rows.repartition("_h1", "_h2").sortWithinPartitions("_h1", "_h2"), f"run{level}")
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(_union(full), level + 1)

    def all_keys(self) -> DataFrame:
        return _union(self.runs())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def dropped_lines(lines: DataFrame, *, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                  fanout: int = FANOUT) -> DataFrame:
    """``_id, _row, _drop``: for each row with lines to drop, their positions in order."""
    per_doc = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_c"))
    often = stored(per_doc.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"))
                   .where(F.col("_docs") >= min_docs).select("_h1", "_h2"), "often")
    held = stored(lines.join(often, ["_h1", "_h2"], "left_semi"), "held")
    parts = [i / batches for i in range(1, batches)]
    cuts = held.approxQuantile("_id", parts, 0.01) if parts and not held.isEmpty() else []
    bounds = sorted(set(cuts), reverse=True)
    runs = LineRuns(fanout)
    for i in range(len(bounds) + 1):
        batch = held
        if i < len(bounds):
            batch = batch.where(F.col("_id") > bounds[i])
        if i > 0:
            batch = batch.where(F.col("_id") <= bounds[i - 1])
        runs.add(batch.groupBy("_h1", "_h2").agg(F.max("_id").alias("_holder")))
    drop = held.join(runs.all_keys(), ["_h1", "_h2"]).where("_id <> _holder")
    return drop.groupBy("_id", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))


def without_positions(lines: Column, drop: Column) -> Column:
    """The array without the (sorted, 0-based) positions: slices between them, linear in its length."""
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(0), F.size(drop)),
                        lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
    return F.flatten(parts)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``id_col, kept_text, n_lines, n_dropped`` for each row of ``docs``.

    Lines end at \\n; a null or empty text is one empty line. Keys of at least ``min_chars`` code points found in
    at least ``min_docs`` documents lose all their lines except those of the largest id that holds the key, where
    repeated lines stay too. Rows that repeat an id count as one document. Rows without an id keep all lines and
    count for nothing. Other columns are ignored; an empty table gives an empty result."""
    lines = stored(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    drop = dropped_lines(lines, min_docs=min_docs, batches=batches, fanout=fanout)
    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                       F.col(text_col).alias("_text"))
    rows = rows.join(drop, ["_id", "_row"], "left").withColumn("_lines", lines_of("_text"))
    none = F.col("_drop").isNull()
    kept = F.when(none, utf8_text("_text")).otherwise(
        F.array_join(without_positions(F.col("_lines"), F.col("_drop")), "\n"))
    return rows.select(F.col("_id").alias(id_col), kept.alias("kept_text"),
                       F.size("_lines").cast("bigint").alias("n_lines"),
                       F.when(none, 0).otherwise(F.size("_drop")).cast("bigint").alias("n_dropped"))
