"""License scan by diagonal voting.

Every word pair of a text is joined with the word pairs of the templates; a hit at word p of the text and word t of
a template votes for diagonal p - t. Diagonals with all pairs of a template are places where its words stand
consecutively. Neighbouring diagonals (a word added or left out) are merged into one span, whose coverage of the
template is the score. A longer notice is verified word by word where its last pair votes: in order, with at most one
word added, left out or changed, and never one of its last words, which tell it from other notices. The template table is the caller's list, a few hundred pairs; nothing else is broadcast.
Votes are aggregated by row before they are shuffled; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import row_key, stored, utf8_text

# Phrases and labels of the contract.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Longer notices with labels of their own, found also where a word is added, left out or changed; and how many of their
# last words must stand as they are.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3-notice", 2),
    ("licensed under the gnu general public license version 2", "gpl-2-notice", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc-4-notice", 3),
    ("licensed under cc by sa 4 0", "cc-by-sa-4-notice", 3),
    ("licensed under the apache license version 2 0", "apache-2-notice", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-notice", 2),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice", 2),
)
MAX_SHIFT = 2
#: Up to so many rows (counted) that may hold a notice are sent to all tasks, which then read no other text.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Template:
    phrase: str
    label: str
    base: bool
    tail: int = 2


TEMPLATES = (*(Template(p, label, True) for p, label in BASE_PHRASES),
             *(Template(p, label, False, tail) for p, label, tail in NOTICES))


def words_of(text_col: str) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case. ``lower`` also folds other letters, which
    no template has; the one that it would turn into a bare ASCII letter (U+212A) is replaced first."""
    low = F.lower(F.replace(utf8_text(text_col), F.lit("K"), F.lit("å")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_pairs(spark, templates=TEMPLATES) -> DataFrame:
    """``tid, tpos, w1, w2``; templates of 2 to 63 words."""
    rows = []
    for tid, t in enumerate(templates):
        words = t.phrase.split()
        if not 2 <= len(words) <= 63:
            raise ValueError("templates have 2 to 63 words")
        rows += [(tid, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "tid int, tpos int, w1 string, w2 string")


def votes(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES) -> DataFrame:
    """``_id, _row, tid, diagonal, mask``: bit t of the mask is set when pair t of the template votes."""
    pairs = F.broadcast(template_pairs(docs.sparkSession, templates)
                        .withColumn("_h", F.xxhash64("w1", "w2")))
    words = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                        words_of(text_col).alias("_w"))
    grams = words.where(F.size("_w") > 1).select(
        "_id", "_row", F.posexplode(F.arrays_zip(F.expr("slice(_w, 1, size(_w) - 1)").alias("a"),
                                                 F.expr("slice(_w, 2, size(_w) - 1)").alias("b"))).alias("_p", "_g"))
    grams = grams.select("_id", "_row", "_p", F.col("_g.a").alias("_a"), F.col("_g.b").alias("_b"),
                         F.xxhash64("_g.a", "_g.b").alias("_h"))
    hits = grams.join(pairs, "_h").where("_a = w1 AND _b = w2")
    return (hits.withColumn("diagonal", F.col("_p") - F.col("tpos"))
            .groupBy("_id", "_row", "tid", "diagonal")
            .agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask")))


def _notices(found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _row, label`` of notices that stand in a text with at most one edit. ``found`` has the phrase and tail of
    each vote; only texts with a vote for a notice's last pair are read again."""
    places = found.where(~F.col("base") & (F.expr("shiftright(mask, n_pairs - 1)") == 1)).select(
        "_id", "_row", "tid", "label", "phrase", "tail", F.col("diagonal").alias("_d"))
    places = stored(places, "places")
    asked = places.select(F.col("_id").alias("_k"), F.col("_row").alias("_kr")).distinct()
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    rows = docs.select(F.col(id_col).alias("_i"), row_key(id_col, text_col).alias("_r"), F.col(text_col).alias("_t"))
    rows = rows.join(asked, (F.col("_r") == F.col("_kr")) & F.col("_i").eqNullSafe(F.col("_k")), "left_semi")
    words = rows.dropDuplicates(["_i", "_r"]).select("_i", "_r", words_of("_t").alias("_w"))
    d = places.join(words, (F.col("_row") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_i")))
    n = F.size("phrase")

    def hits(shift: int, turned: bool) -> Column:
        """How many words of the notice match from its beginning (``turned``: its end) on a diagonal near this one."""
        each = F.transform("phrase", lambda w, t: F.coalesce(F.get("_w", F.col("_d") + t + shift) == w, F.lit(False)))
        at = F.array_position(F.reverse(each) if turned else each, False)
        return F.when(at == 0, n).otherwise(at.cast("int") - 1)

    end, same, added, left_out = hits(0, True), hits(0, False), hits(-1, False), hits(1, False)
    fits = (end + same >= n - 1) | (end + added >= n) | (end + left_out >= n - 1)
    return d.where((end >= F.col("tail")) & fits).select("_id", "_row", "label").distinct()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES,
                 max_shift: int = MAX_SHIFT) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``docs``.

    ``n_base`` counts the places where all words of a base phrase stand consecutively; ``first_word`` and
    ``last_word`` are their smallest and largest start, null without a place. ``labels`` adds those of the notices that
    stand somewhere with at most one word added, left out or changed before their last ``tail`` words. ``score`` is
    the best share of a template's pairs on diagonals at most ``max_shift`` apart. Null texts count as empty (0 words,
    empty labels, score 0); rows without an id and rows that repeat an id are scanned like any other; an empty table
    gives an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    facts = F.broadcast(spark.createDataFrame(
        [(i, t.label, t.base, len(t.phrase.split()) - 1, t.phrase.split(), t.tail) for i, t in enumerate(templates)],
        "tid int, label string, base boolean, n_pairs int, phrase array<string>, tail int"))
    found = stored(votes(docs, id_col, text_col, templates), "votes").join(facts, "tid")
    whole = F.col("base") & (F.bit_count("mask") == F.col("n_pairs"))
    along = W.partitionBy("_id", "_row", "tid").orderBy("diagonal")
    spans = (found.withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(along) > max_shift).cast("int"))
             .withColumn("_span", F.sum(F.coalesce("_new", F.lit(0))).over(along))
             .groupBy("_id", "_row", "tid", "label", "base", "n_pairs", "_span")
             .agg(F.bit_or("mask").alias("mask"), F.count_if(whole).alias("places"),
                  F.min(F.when(whole, F.col("diagonal"))).alias("first"),
                  F.max(F.when(whole, F.col("diagonal"))).alias("last"))
             .withColumn("coverage", F.bit_count("mask") / F.col("n_pairs"))
             .withColumn("known", F.when(F.col("base") & (F.col("places") > 0), F.col("label"))))
    none = lambda kind: F.lit(None).cast(kind)
    notices = _notices(found, docs, id_col, text_col).select(
        "_id", "_row", none("bigint").alias("places"), none("int").alias("first"), none("int").alias("last"),
        none("string").alias("known"), F.col("label").alias("noticed"), none("double").alias("coverage"))
    every = spans.select("_id", "_row", "places", "first", "last", "known", none("string").alias("noticed"),
                         "coverage").union(notices)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    per_row = every.groupBy("_id", "_row").agg(
        F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        joined(F.collect_set("known")).alias("base_labels"),
        joined(F.array_distinct(F.concat(F.collect_set("known"), F.collect_set("noticed")))).alias("labels"),
        F.max("coverage").alias("score"))
    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                       F.size(words_of(text_col)).cast("bigint").alias("n_words"))
    out = rows.alias("r").join(per_row.alias("p"), (F.col("r._row") == F.col("p._row"))
                               & F.col("r._id").eqNullSafe(F.col("p._id")), "left")
    return out.select(F.col("r._id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
                      F.col("first_word").cast("bigint").alias("first_word"),
                      F.col("last_word").cast("bigint").alias("last_word"),
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                      F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
