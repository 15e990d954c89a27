"""Checklist verification of extracted fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..plans.stage import materialise, stored

MIN_SCORE = 62.0
BROADCAST_ROWS = 50_000
ALIKE_CHARS = 200
CONCEPTS_PER_PASS = 64
SALTS = 16


def clamp_min_score(x: float) -> float:
    return max(40.0, min(float(x), 100.0))


def clean_concepts(concepts: Sequence[str]) -> list[str]:
    return [c.strip() for c in concepts if c and c.strip()]


def match_strings(fields_label: Column, name: Column, field_id: Column) -> Column:
    """The non-blank texts a field can be matched by."""
    return F.filter(F.transform(F.array(fields_label, name, field_id), tx.strip),
                    lambda x: x.isNotNull() & (x != ""))


def _scored_alike(t: Column, concepts: Sequence[str]) -> Column:
    """The text with 0 for each of its digits, where no score can tell.

    A digit no concept has is never matched, so it counts by its place alone. Where one token at most holds any, that token
    stays apart from the others and in its place among them. Texts beyond ASCII or ALIKE_CHARS are left as they are."""
    if any(ch in "0123456789" for c in concepts for ch in c):
        return t
    plain = t.rlike("[0-9]") & (F.octet_length(t) <= ALIKE_CHARS) & (F.length(t) == F.octet_length(t))
    several = t.rlike(r"(?s)[0-9].*[\s\x1c-\x1f].*[0-9]")
    return F.when(plain, F.when(several, t).otherwise(F.translate(t, "123456789", "0" * 9))).otherwise(t)


def best_fields(fields: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Best field per document and concept with its score, for every document that has fields.

    Labels repeat from form to form, some but for a number, so distinct texts (``_scored_alike``) are scored, each against
    the whole checklist at once, and joined back: up to BROADCAST_ROWS of them by broadcast, more by a shuffle in which a text that stands in very many rows is
    dealt over SALTS keys. The arg-max is a partial aggregate, so a document with very many fields is reduced inside each
    task first. Ties go to the first field."""
    cs = list(concepts)
    texts = match_strings(F.col("label"), F.col("name"), F.col("field_id"))
    payload = F.struct(F.coalesce(F.nullif("field_id", F.lit("")), F.col("name")).alias("field_id"),
                       F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("name")).alias("label"),
                       "value")
    rows = fields.select("doc_id", "field_seq", payload.alias("f"), F.explode(F.array_distinct(F.transform(texts, F.lower))).alias("_t"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_z"))
    rows = stored(rows.withColumn("_t", _scored_alike(F.col("_t"), cs)), "texts")  # read twice, the first time only the texts
    known = materialise(rows.select("_t").distinct().withColumn("s", sim.concept_scores(F.array("_t"), cs)))
    if known.count() <= BROADCAST_ROWS:
        scored = rows.join(F.broadcast(known), "_t")
    else:
        scored = rows.join(known.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["_t", "_z"])
    best = [F.min(F.struct((-F.col("s")[i]).alias("k"), "field_seq", "f")).alias(f"b{i}")
            for i in range(len(cs))]
    wide = scored.groupBy("doc_id").agg(*best)
    rows = F.array(*[F.struct(F.lit(i).alias("concept_seq"), F.lit(c).alias("concept"),
                              (-F.col(f"b{i}.k")).alias("score"), F.col(f"b{i}.f").alias("f"))
                     for i, c in enumerate(cs)])
    return wide.select("doc_id", F.inline(rows))


def checks(documents: DataFrame, fields: DataFrame, concepts: Sequence[str], *,
           min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and concept, also for documents without fields."""
    cs = clean_concepts(concepts)
    need = clamp_min_score(min_score)
    if not cs:  # no checks at all; see ``verdicts``
        return documents.limit(0).select("doc_id", F.expr(
            "named_struct('concept_seq', 0, 'concept', '', 'status', '', 'matched_field_id', '', 'matched_label', '', "
            "'value', '', 'match_score', 0D, '_whole', 0L)").alias("c")).select("doc_id", "c.*")
    parts = []
    for start in range(0, len(cs), CONCEPTS_PER_PASS):
        part = cs[start:start + CONCEPTS_PER_PASS]
        best = best_fields(fields, part)
        plan = F.explode(F.array(*[F.struct(F.lit(i).alias("concept_seq"), F.lit(c).alias("concept"))
                                   for i, c in enumerate(part)]))
        wanted = documents.select("doc_id", plan.alias("p")).select("doc_id", "p.*")
        got = wanted.join(best.drop("concept"), ["doc_id", "concept_seq"], "left")
        parts.append(got.withColumn("concept_seq", F.col("concept_seq") + start))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    score = F.coalesce("score", F.lit(0.0))
    hit = (score >= need) & (score > 0)
    return out.select(
        "doc_id", "concept_seq", "concept",
        F.when(~hit, "not_found").when(tx.missing_value(F.col("f.value")), "null_or_empty")
        .otherwise("ok").alias("status"),
        F.when(hit, F.col("f.field_id")).alias("matched_field_id"),
        F.when(hit, F.col("f.label")).alias("matched_label"),
        F.when(hit, F.col("f.value")).alias("value"), F.round(score, 1).alias("match_score"),
        F.bround(score, 0).cast("bigint").alias("_whole"))


def messages(checked: DataFrame, documents: DataFrame, *, min_score: float = MIN_SCORE) -> DataFrame:
    """Issue lines: one per check that is not ok."""
    need = str(clamp_min_score(min_score))
    d = checked.filter(F.col("status") != "ok").join(documents.select("doc_id", "filename"), "doc_id")
    q = F.concat(F.col("filename"), F.lit(": "))
    shown = F.coalesce("matched_label", "matched_field_id")
    return d.select("doc_id", "concept_seq", F.when(
        F.col("status") == "not_found",
        F.concat(q, F.lit("no field matched for '"), F.col("concept"), F.lit("' (fuzzy score "),
                 F.col("_whole").cast("string"), F.lit(f" < {need})")))
        .otherwise(F.concat(q, F.lit("'"), F.col("concept"), F.lit("' matched '"), shown,
                            F.lit("' but value is null or empty"))).alias("message"))


def verdicts(checked: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``all_ok`` per document: at least one check and every check ok. With ``documents``, those without any check
    get a row too."""
    out = checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_checks"), F.bool_and(F.col("status") == "ok").alias("all_ok"),
        F.count_if(F.col("status") != "ok").alias("n_issues"))
    if documents is None:
        return out
    return documents.select("doc_id").distinct().join(out, "doc_id", "left").select(
        "doc_id", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("all_ok", F.lit(False)).alias("all_ok"),
        F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def summary(checked: DataFrame, n_concepts: int) -> DataFrame:
    return verdicts(checked).agg(
        F.count(F.lit(1)).alias("pdf_count"), F.lit(n_concepts).cast("bigint").alias("concepts_count"),
        F.count_if("all_ok").alias("pdfs_all_ok"), F.count_if(~F.col("all_ok")).alias("pdfs_with_issues"),
        F.coalesce(F.sum("n_issues"), F.lit(0)).alias("issue_lines"))


def verify_only_summary(checked: DataFrame, errors: DataFrame) -> DataFrame:
    """The summary of a verification without a session: read failures count as issues."""
    ok = verdicts(checked).agg(F.count(F.lit(1)).alias("processed_ok"),
                               F.count_if(~F.col("all_ok")).alias("_issues"))
    bad = errors.agg(F.count(F.lit(1)).alias("failed_read_or_extract"))
    n = F.col("failed_read_or_extract")
    return ok.withColumn("_j", F.lit(1)).join(bad.withColumn("_j", F.lit(1)), "_j").select(
        (F.col("processed_ok") + n).alias("total_uploaded"), "processed_ok", "failed_read_or_extract",
        (F.col("_issues") + n).alias("pdfs_with_missing_or_unmatched"))


def parse_checklist(text: str, spark) -> list[str]:
    """The concepts of one checklist text, parsed by the same expression as a column of them."""
    row = spark.range(1).select(tx.parse_checks(F.lit(text)).alias("c")).first()
    return list(row["c"] or [])
