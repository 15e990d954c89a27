"""One run over a folder: catalog, split of the uploads, field detection, checks, messages and summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import fields as fld
from . import verify


class FolderRun(NamedTuple):
    accepted: DataFrame
    errors: DataFrame
    fields: DataFrame
    checks: DataFrame
    verdicts: DataFrame
    messages: DataFrame
    summary: DataFrame


def all_messages(checked: DataFrame, accepted: DataFrame, errors: DataFrame, *,
                 min_score: float = verify.MIN_SCORE) -> DataFrame:
    """Issue lines of the checks, then a line for each upload that could not be read: filename, message, is_error."""
    name = accepted.select("doc_id", "filename")
    lines = verify.messages(checked, accepted, min_score=min_score).join(name, "doc_id").select(
        "doc_id", "concept_seq", "filename", "message", F.lit(False).alias("is_error"))
    failed = errors.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("concept_seq"), "filename",
        # Fixed value: wording of the output.
        F.concat("filename", F.lit(": ERROR — "), "detail").alias("message"), F.lit(True).alias("is_error"))
    return lines.unionByName(failed)


def run_folder(uploads: DataFrame, blocks: DataFrame, concepts: Sequence[str], *, min_score: float = verify.MIN_SCORE,
               detect: Callable[[DataFrame], DataFrame] = fld.detect_fields) -> FolderRun:
    """``uploads``: doc_id, upload_index, filename and, where reading failed, detail. Blocks of other documents are
    left out. With an empty checklist no document is all right."""
    accepted, errors = tables.split_uploads(uploads)
    found = detect(blocks.join(accepted.select("doc_id"), "doc_id", "left_semi"))
    checked = verify.checks(accepted, found, concepts, min_score=min_score)
    return FolderRun(accepted, errors, found, checked, verify.verdicts(checked, accepted),
                     all_messages(checked, accepted, errors, min_score=min_score),
                     verify.verify_only_summary(checked, errors))
