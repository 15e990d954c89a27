"""Registered queries: every operator run over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import similarity as sim
from .functions import text as tx
from .operators import embedded, fields, folder, hits, layout, ocr, review, search, search_table, verify
from .plans import derive, stage
from .sources import tables

WORD_QUERIES = ["that", "etre", "The and", "thaner", "10"]
DIGIT_QUERIES = ["1997/05 28", "(0000) 0100", "0000.7919"]
PHRASES = ["the and", "thaner", "los de", "und der"]
TYPED = [*WORD_QUERIES, *PHRASES, "55501", "1 5", "mentrel le", "000 1"]
CONCEPTS = ["policy number", "Order Date", "member name", "signature", "first name"]
BOX = ["x0", "y0", "x1", "y1"]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return derive.spread(derive.table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return derive.line_blocks(_documents(spark, sf))


def _words(spark: SparkSession, sf: str, pitch: int = 30) -> DataFrame:
    return derive.word_blocks(_documents(spark, sf), pitch)


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    orders = derive.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return derive.form_blocks(orders, derive.table(spark, sf, "customer"))


def _form_documents(spark: SparkSession, sf: str) -> DataFrame:
    o = derive.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("doc_id"), F.concat(F.lit("form-"), key.cast("string"),
                                      F.when(key % 7 == 0, ".txt").otherwise(".PDF")).alias("filename"),
        key.alias("upload_index"), (key % 5 == 0).alias("extraction_pending"),
        F.concat(F.lit("  "), F.col("o_orderpriority")).alias("transaction_type"),
        F.col("o_orderstatus").alias("carrier"), F.lit(None).cast("string").alias("vertical"))


def _i64(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def _hit_view(d: DataFrame) -> DataFrame:
    return d.select(*_i64("doc_id", "page", "query_id"), *BOX, "snippet", "source", "match_type")


# ---- search ----------------------------------------------------------------------------------------

def q_exact(spark, sf):
    return _hit_view(search.search_exact(_lines(spark, sf), WORD_QUERIES))


def q_many(spark, sf):
    """Every sentence of the benchmark texts, looked up in every line."""
    b = derive.table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("n", "text"))
    asked = b.select((F.col("item_id") * 100000 + F.col("n")).alias("query_id"), "text")
    return _hit_view(search.search_many(_lines(spark, sf), asked))


def q_table(spark, sf):
    """The cascade up to the merged lines for a table of queries: every sentence of the benchmark texts, words, phrases
    and numbers, looked up in pages of words whose rows lie so close that a page is one line."""
    b = derive.table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("n", "text"))
    asked = b.select((F.col("item_id") * 100000 + F.col("n")).alias("query_id"), "text")
    typed = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TYPED)], "query_id bigint, text string")
    return _hit_view(search_table.search_table(_words(spark, sf, 15), asked.unionByName(typed)))


def q_batch(spark, sf):
    """Hits of a batch of forms with the file they are in."""
    found = search.with_filename(search.search_exact(_forms(spark, sf), ["Member Name", "BUILDING segment", "F"]),
                                 _form_documents(spark, sf))
    return found.select(*_i64("doc_id", "page", "query_id"), "filename", *BOX, "snippet", "source", "match_type")


def q_exact_loose(spark, sf):
    return _hit_view(search.search_exact_loose(_lines(spark, sf), WORD_QUERIES))


def q_digits(spark, sf):
    """Dates and numbers of the forms, typed with other separators."""
    return _hit_view(search.search_digits(_forms(spark, sf), DIGIT_QUERIES))


def q_cascade(spark, sf):
    return _hit_view(search.search_blocks(_lines(spark, sf), WORD_QUERIES))


def q_boundary_positions(spark, sf):
    low = F.lower("text")
    return _lines(spark, sf).select(
        *_i64("doc_id", "block_seq"), F.explode(tx.phrase_indices(low, "the")).alias("idx")).withColumn(
        "idx", F.col("idx").cast("bigint"))


def q_merged_line(spark, sf):
    return _hit_view(search.search_lines(_words(spark, sf), PHRASES))


def q_line_page(spark, sf):
    """Row pitch below the tolerance: a page is one line, longer than a segment."""
    return _hit_view(search.search_lines(_words(spark, sf, 15), PHRASES))


def q_fuzzy_ratio(spark, sf):
    w = tx.with_norm(_words(spark, sf), "text", "norm")
    d = w.withColumn("score", F.when(F.abs(F.length("norm") - 6) <= sim.max_length_delta(6),
                                     sim.ratio(F.col("norm"), "thaner")))
    return d.filter(F.col("score") >= 76).select(*_i64("doc_id", "block_seq"), "norm", "score")


def q_fuzzy_tokens(spark, sf):
    return _hit_view(search.search_fuzzy(_lines(spark, sf), ["thaner", "etres", "mentrelle"]))


def q_fuzzy_lev(spark, sf):
    w = _words(spark, sf)
    d = w.withColumn("score", sim.keyword_similarity(F.col("text"), "thaner").cast("bigint"))
    return d.filter(F.col("score") >= sim.embedded_threshold(6)).select(
        *_i64("doc_id", "block_seq"), "text", "score")


def q_token_set(spark, sf):
    d = _lines(spark, sf).withColumn("score", sim.token_set_ratio(F.lower("text"), "the and that"))
    return d.filter(F.col("score") >= 62).select(*_i64("doc_id", "block_seq"), "score")


def q_partial(spark, sf):
    d = _words(spark, sf).withColumn("score", sim.partial_ratio(F.lower("text"), "thaner"))
    return d.filter(F.col("score") >= 80).select(*_i64("doc_id", "block_seq"), "text", "score")


def q_score_lines(spark, sf):
    lines = layout.line_table(layout.assign_lines(_words(spark, sf)), by_x=False)
    d = search.score_lines(lines, "than the")
    return d.filter(F.col("partial") >= 80).select(
        *_i64("doc_id", "page", "line_start"), "partial", "token_sort", "match_type")


def q_best_block(spark, sf):
    d = search.best_block_per_line(layout.assign_lines(_words(spark, sf)), "thaner")
    return d.select(*_i64("doc_id", "page", "line_start", "block_seq"), "text", "score")


def q_hit_stats(spark, sf):
    h = search.search_exact(_lines(spark, sf), WORD_QUERIES)
    return hits.hit_stats(h, derive.table(spark, sf, "documents").select("doc_id")).select(
        *_i64("query_id", "docs_with_hits", "docs_total", "match_count"))


def q_hit_order(spark, sf):
    h = search.search_exact(_lines(spark, sf), ["that"])
    return hits.in_reading_order(h).select(
        *_i64("doc_id", "page", "query_id", "hit_no", "prev_no", "next_no"), "x0", "y0")


def q_embedded(spark, sf):
    items = derive.embedded_items(_lines(spark, sf))
    return _hit_view(embedded.search_embedded(items, ["that", "thaner", "und der"]))


def q_embedded_lines(spark, sf):
    """Base lines over word items."""
    items = derive.embedded_items(_words(spark, sf))
    d = embedded.anchored_lines(items)
    return d.groupBy("doc_id", "page", "line_start").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(
        *_i64("doc_id", "page"), "line_start", "n_items", "x0", "x1")


def q_hybrid(spark, sf):
    b = _lines(spark, sf)
    d = hits.hybrid_find(derive.embedded_items(b), b, ["that", "thaner"])
    return d.select(*_i64("doc_id", "page", "query_id", "priority"), *BOX, "snippet", "source", "match_type")


def q_priority(spark, sf):
    """Match priority of every exact hit, taken from either layer."""
    h = search.search_exact(_lines(spark, sf), ["that", "2024"])
    src = F.when(F.col("doc_id") % 2 == 0, "embedded").otherwise("ocr")
    d = h.withColumn("source", src).withColumn(
        "priority", hits.match_priority(F.col("source"), F.col("match_type"), F.col("query_id") == 1))
    return d.groupBy("query_id", "source", "match_type", "priority").agg(F.count(F.lit(1)).alias("n")).select(
        *_i64("query_id", "priority", "n"), "source", "match_type")


def q_highlight(spark, sf):
    """Every exact hit as a view rectangle (page 612 x 792 to 918 x 1188)."""
    h = search.search_exact(_lines(spark, sf), ["that"])
    v = geo.scale_to_view(geo.box_of(), F.lit(612.0), F.lit(792.0), F.lit(918.0), F.lit(1188.0), variant="search")
    return h.select(*_i64("doc_id", "page"), v.alias("v")).select("doc_id", "page", "v.*")


def d_grid(spark, sf):
    from .operators import dedupe
    h = search.search_exact(_lines(spark, sf), ["that", "the"])
    g = dedupe.first_per_key(h, ["doc_id", "page"], dedupe.grid_keys(64.0), ["block_seq", "query_id"])
    return g.select(*_i64("doc_id", "page", "block_seq", "query_id"), *BOX)


def d_greedy(spark, sf):
    """Greedy dedupe over boxes that do overlap: hits of two nested queries under one number."""
    from .operators import dedupe
    h = search.search_exact_loose(_lines(spark, sf), ["that", "hat"]).withColumn("query_id", F.lit(0))
    return dedupe.ocr_hits(h, search.MATCH_RANK).select(*_i64("doc_id", "page"), *BOX, "match_type")


# ---- layout ----------------------------------------------------------------------------------------

def l_reading_order(spark, sf):
    raw = _words(spark, sf).drop("block_seq")
    return tables.to_blocks(raw).select(*_i64("doc_id", "page", "block_seq"), "text", "x0", "y0")


def l_lines(spark, sf):
    d = layout.line_table(layout.assign_lines(_words(spark, sf)))
    return d.select(*_i64("doc_id", "page", "line_start", "n_blocks"), *BOX, "text")


def l_lines_tight(spark, sf):
    d = layout.line_table(layout.assign_lines(_words(spark, sf, 15)))
    return d.select(*_i64("doc_id", "page", "line_start", "n_blocks"), *BOX, "text")


def l_paragraphs(spark, sf):
    return layout.paragraphs(_lines(spark, sf)).select(*_i64("doc_id", "page", "n_lines"), "y0", "y1", "text")


def l_pages(spark, sf):
    return layout.readable_pages(_lines(spark, sf)).select(*_i64("doc_id", "page", "paragraph_count"), "text")


def l_readable(spark, sf):
    return layout.readable_documents(_words(spark, sf)).select(
        *_i64("doc_id", "line_count", "paragraph_count"), "full_text")


def l_prompt(spark, sf):
    return layout.prompt_text(_lines(spark, sf)).select(*_i64("doc_id"), "prompt")


# ---- fields ----------------------------------------------------------------------------------------

def _field_view(d: DataFrame) -> DataFrame:
    return d.select(*_i64("doc_id", "field_seq"), "field_id", "name", "label", "value", *_i64("page"), *BOX,
                    "confidence", "detection")


def f_label_value(spark, sf):
    d = fields.label_value_fields(_forms(spark, sf), include_placeholders=True)
    return d.select(*_i64("doc_id", "block_seq", "page"), "field_id", "label", "value", "confidence", "detection")


def f_dynamic(spark, sf):
    return _field_view(fields.detect_fields(_forms(spark, sf)))


def f_dynamic_documents(spark, sf):
    return _field_view(fields.detect_fields(_lines(spark, sf)))


def f_standalone(spark, sf):
    """Lone dates and ids."""
    d = fields.detect_fields(_forms(spark, sf))
    return _field_view(d.filter(F.col("detection") == "standalone_pattern"))


def f_keyword(spark, sf):
    return _field_view(fields.keyword_fields(_forms(spark, sf)))


def f_state(spark, sf):
    d = fields.extract_fields(_forms(spark, sf))
    return d.select(*_i64("doc_id", "priority", "page"), "field_id", "value", "section", "status", "confidence",
                    "needs_review")


def _completed(spark, sf):
    o = derive.table(spark, sf, "orders")
    ids = F.when(F.col("o_orderkey") % 3 == 0, "policy_number").when(
        F.col("o_orderkey") % 3 == 1, "unknown_field").otherwise("order_status")
    return o.select(F.col("o_orderkey").alias("doc_id"), ids.alias("field_id"))


def f_queue(spark, sf):
    f = fields.extract_fields(_forms(spark, sf))
    d = review.next_fields(review.apply_completions(f, _completed(spark, sf)))
    return d.select(*_i64("doc_id", "priority", "page"), "field_id", "value", "section")


def f_progress(spark, sf):
    f = fields.extract_fields(_forms(spark, sf))
    return review.progress(review.apply_completions(f, _completed(spark, sf))).select(
        *_i64("doc_id", "pending", "completed", "needs_review"))


def r_completions(spark, sf):
    """Completed fields, by way of the review log: appended, read back and reduced."""
    path = f"{stage.shared_folder(spark)}/review-{uuid.uuid4().hex}"
    done = _completed(spark, sf).select(F.lit(review.COMPLETE).alias("action"), "doc_id", F.col("field_id").alias("detail"))
    review.append_actions(done, path)
    review.append_actions(done.union(done.withColumn("action", F.lit("OPEN")).withColumn("detail", F.lit("seen"))), path)
    return review.completions(review.read_log(spark, path)).select(*_i64("doc_id"), "field_id")


def f_unknown(spark, sf):
    f = fields.detect_fields(_forms(spark, sf))
    return review.unknown_completions(f, _completed(spark, sf)).select(*_i64("doc_id"), "field_id")


def _answers(spark, sf):
    c = derive.table(spark, sf, "customer").select("c_custkey", "c_name")
    o = derive.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    conf = F.when(F.col("o_orderkey") % 2 == 0, "0.95").otherwise("n/a")
    return j.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("bigint").alias("field_seq"),
        F.lit("policy_number").alias("field_id"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 1, "PQL-").otherwise("POL-"),  # some read with one wrong letter
                 F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("value"),
        conf.alias("confidence"), F.lit("external").alias("source"))


def f_merge(spark, sf):
    a = _answers(spark, sf).withColumn("confidence", tx.coerce_float(F.col("confidence"), 0.75))
    a = a.withColumn("name", F.col("field_id"))
    d = fields.merge_fields(fields.detect_fields(_forms(spark, sf)), a)
    return d.select(*_i64("doc_id"), "field_id", "value", "label", "confidence", "detection", "source")


def f_align(spark, sf):
    d = fields.align_values(_answers(spark, sf), _forms(spark, sf), ["doc_id", "field_seq"])
    return d.select(*_i64("doc_id", "page", "block_seq"), *BOX, "score")


def f_answers(spark, sf):
    d = fields.accept_answers(_answers(spark, sf), _forms(spark, sf))
    return d.select(*_i64("doc_id", "page"), "field_id", "value", *BOX, "confidence", "source")


def f_corrections(spark, sf):
    o = derive.table(spark, sf, "orders")
    c = o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("bigint").alias("seq"),
        F.lit("member_name").alias("field_id"), (F.col("o_orderkey") % 2 == 0).alias("value_ok"),
        F.lit(" Order Date: ").alias("suggested_value"),
        F.when(F.col("o_orderkey") % 3 == 0, "1.7").otherwise("bad").alias("adjusted_confidence"))
    b = _forms(spark, sf)
    d = fields.apply_corrections(fields.detect_fields(b), c, b)
    return d.select(*_i64("doc_id", "page"), "field_id", "value", "y0", "confidence", "gpt_validated")


def f_known_priority(spark, sf):
    d = fields.keyword_fields(_forms(spark, sf))
    p = fields.known_priority(F.lit(None).cast("string"), F.col("field_id"), F.col("name"))
    return d.groupBy("field_id", p.alias("priority")).agg(F.count(F.lit(1)).alias("n")).select(
        "field_id", *_i64("priority", "n"))


# ---- verification ----------------------------------------------------------------------------------

def _checks(spark, sf):
    return verify.checks(_form_documents(spark, sf), fields.detect_fields(
        _forms(spark, sf), include_placeholders=True), CONCEPTS)


def v_checks(spark, sf):
    return _checks(spark, sf).select(
        *_i64("doc_id", "concept_seq"), "concept", "status", "matched_field_id", "matched_label", "value", "match_score")


def v_verdicts(spark, sf):
    return verify.verdicts(_checks(spark, sf)).select(*_i64("doc_id", "n_checks", "n_issues"), "all_ok")


def v_messages(spark, sf):
    return verify.messages(_checks(spark, sf), _form_documents(spark, sf)).select(
        *_i64("doc_id", "concept_seq"), "message")


def v_summary(spark, sf):
    return verify.summary(_checks(spark, sf), len(CONCEPTS)).select(
        *_i64("pdf_count", "concepts_count", "pdfs_all_ok", "pdfs_with_issues", "issue_lines"))


def v_verify_only(spark, sf):
    docs = _form_documents(spark, sf)
    good, bad = tables.split_uploads(docs)
    ck = verify.checks(good, fields.detect_fields(_forms(spark, sf)), CONCEPTS)
    d = verify.verify_only_summary(ck, bad)
    return d.select(*_i64(*d.columns))


# ---- OCR layers ------------------------------------------------------------------------------------

def _ocr(spark, sf):
    return derive.ocr_words(_words(spark, sf))


def o_filter(spark, sf):
    d = ocr.clean_words(_ocr(spark, sf), strict=True)
    return d.select(*_i64("doc_id", "page", "engine", "block_seq"), "text", *BOX)


def o_pick(spark, sf):
    d = ocr.pick_pass(ocr.pick_engine(ocr.layer_stats(ocr.clean_words(_ocr(spark, sf)))))
    return d.select(*_i64("doc_id", "page", "ocr_pass", "engine"))


def o_polygons(spark, sf):
    """Every second word outlined by a polygon in pixels, its corners in any order."""
    w = _words(spark, sf).filter(F.col("block_seq") % 2 == 0)
    corner = lambda x, y: F.struct((F.col(x) * 2).alias("x"), (F.col(y) * 4).alias("y"))
    middle = F.struct((F.col("x0") + F.col("x1")).alias("x"), (F.col("y0") * 2 + F.col("y1") * 2).alias("y"))
    p = w.withColumn("polygon", F.array(corner("x1", "y1"), middle, corner("x0", "y0"), corner("x1", "y0"), corner("x0", "y1")))
    p = p.drop(*BOX).withColumns({"scale_x": F.lit(0.5), "scale_y": F.lit(0.25)})
    return ocr.polygon_words(p).select(*_i64("doc_id", "page", "block_seq"), "text", *BOX)


def o_needs(spark, sf):
    d = ocr.page_needs_ocr(_lines(spark, sf), min_page_chars=200, min_native_score=100)
    return d.select(*_i64("doc_id", "page", "page_chars", "native_score"), "weak")


def o_merge(spark, sf):
    """The layer chosen for each page over the native blocks."""
    chosen = ocr.choose_ocr_layer(ocr.clean_words(_ocr(spark, sf)))
    d = ocr.merge_layers(chosen, _words(spark, sf))
    return d.select(*_i64("doc_id", "page", "block_seq"), "text", *BOX, "source")


def o_route(spark, sf):
    d = ocr.route_pages(_words(spark, sf), ocr.clean_words(_ocr(spark, sf)))
    return d.select(*_i64("doc_id", "page", "block_seq"), "text", "source")


# ---- catalog, labels, log --------------------------------------------------------------------------

def c_catalog(spark, sf):
    f = fields.detect_fields(_forms(spark, sf))
    d = tables.with_hint(tables.session_labels(tables.catalog(_form_documents(spark, sf), f, _forms(spark, sf))))
    return d.select(*_i64("doc_id", "field_count", "block_count"), "filename", "transaction_type", "carrier",
                    "vertical", "hint")


def c_errors(spark, sf):
    return tables.split_uploads(_form_documents(spark, sf))[1].select(*_i64("upload_index"), "filename", "detail")


def c_accepted(spark, sf):
    return tables.split_uploads(_form_documents(spark, sf))[0].select(*_i64("doc_id", "upload_index"), "filename")


def c_deferred(spark, sf):
    """Deferred extraction in two runs over one field store: what isn't pending first, then chosen ids, some of them
    unknown. Documents with their flag and stored fields, and the unknown ids."""
    docs, blocks = _form_documents(spark, sf), _forms(spark, sf)
    path = f"{stage.shared_folder(spark)}/fields-{uuid.uuid4().hex}"
    ready = docs.filter(~F.col("extraction_pending"))
    tables.write_fields(fields.detect_fields(blocks.join(ready.select("doc_id"), "doc_id", "left_semi")), path)
    even = docs.filter(F.col("extraction_pending") & (F.col("doc_id") % 2 == 0)).select("doc_id")
    asked = even.union(docs.filter(F.col("doc_id") % 50 == 0).select(-F.col("doc_id")))
    after, unknown = tables.extract_deferred(docs, blocks, asked, path, fields.detect_fields)
    known = tables.read_fields(spark, path)
    counts = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), F.max("value").alias("last_value"))
    rows = after.join(counts, "doc_id", "left").select(*_i64("doc_id"), "extraction_pending", F.coalesce(
        "n_fields", F.lit(0)).alias("n_fields"), "last_value", F.lit(None).cast("string").alias("detail"))
    return rows.unionByName(unknown.select("doc_id", "detail"), allowMissingColumns=True)


def c_folder(spark, sf):
    """Lines of a folder run: issues of the accepted documents, errors of the others."""
    done = folder.run_folder(_form_documents(spark, sf), _forms(spark, sf), CONCEPTS,
                             detect=lambda b: fields.detect_fields(b, include_placeholders=True))
    return done.messages.select(*_i64("doc_id", "concept_seq"), "filename", "message", "is_error")


def c_numbered(spark, sf):
    d = tables.number_files(derive.table(spark, sf, "pages").select(F.col("url").alias("name"), "page_id"))
    return d.select(*_i64("page_id", "position"), "name")


def c_checks_parse(spark, sf):
    """Checklists in all forms, made of the text of conversations."""
    t = derive.table(spark, sf, "conversations")
    both, one = F.to_json(F.array("role", "text")), F.to_json(F.array("text"))
    string = F.substring(one, F.lit(2), F.length(one) - 2)
    form = F.when(F.col("turn") % 3 == 0, both).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(string)
    d = t.select("conv_id", "turn", F.posexplode(tx.parse_checks(form)).alias("n", "concept"))
    return d.select(*_i64("conv_id", "turn", "n"), "concept")


def c_reply_parse(spark, sf):
    """Model replies with prose around a JSON list, one object per event payload."""
    e = derive.table(spark, sf, "events")
    reply = F.concat(F.lit('Sure: [7, {"field_id":"'), F.col("event_type"), F.lit('","value":"'),
                     F.col("user_id").cast("string"), F.lit('","confidence":'), F.col("value").cast("string"),
                     F.lit('}, "x"] done'))
    d = fields.parse_answers(e.select(F.col("event_id").alias("doc_id"), reply.alias("reply")))
    return d.select(*_i64("doc_id", "field_seq"), "field_id", "value", "source")


def r_latest(spark, sf):
    e = derive.table(spark, sf, "events")
    log = e.select("ts", F.col("event_type").alias("action"), F.col("user_id").alias("doc_id"),
                   F.col("props").alias("detail"))
    return tables.latest(log).select("ts", "action", *_i64("doc_id"), "detail")


def t_normalise(spark, sf):
    d = _documents(spark, sf)
    return tx.with_norm(d, "text", "norm").select(
        *_i64("doc_id"), "norm", tx.digits_only(F.col("text")).alias("digits"),
        tx.printable_chars(F.col("text")).cast("bigint").alias("printable"))


def t_labels(spark, sf):
    """Label and value tests, slug and confidence over every text line."""
    t = F.col("text")
    return _lines(spark, sf).select(
        *_i64("doc_id", "block_seq"), tx.slug(t).alias("slug"), tx.looks_like_label(t).alias("is_label"),
        tx.looks_like_plain_value(t).alias("is_value"), tx.stacked_value_ok(t).alias("is_stacked"),
        tx.looks_empty(t).alias("is_empty"), tx.is_date_alone(t).alias("is_date"),
        tx.is_id_alone(t).alias("is_id"), tx.is_stamp(t, drop_spaces=True).alias("is_stamp"))


def t_casts(spark, sf):
    """Tolerant numbers and hyphenated titles over values of many shapes."""
    e = derive.table(spark, sf, "events")
    shape = F.col("event_id") % 4
    raw = (F.when(shape == 0, F.col("user_id").cast("string")).when(shape == 1, F.col("event_type"))
           .when(shape == 2, F.concat(F.col("user_id").cast("string"), F.lit("x"))))
    c = derive.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    title = F.concat(F.initcap("c_mktsegment"), F.lit("-"), F.when(F.col("c_custkey") % 3 == 0, F.initcap("c_mktsegment"))
                     .otherwise(F.col("c_name")))
    casts = e.select(F.col("event_id").alias("id"), tx.coerce_int(raw, 99).cast("bigint").alias("number"),
                     tx.coerce_float(raw).alias("real"), F.lit(None).cast("boolean").alias("is_title"))
    return casts.unionByName(c.select((-F.col("c_custkey") - 1).alias("id"), F.lit(None).cast("bigint").alias("number"),
                                      F.lit(None).cast("double").alias("real"), tx.looks_like_title_hyphen(title).alias("is_title")))


NAMES = [
    "q_exact", "q_many", "q_table", "q_batch", "q_exact_loose", "q_digits", "q_cascade", "q_boundary_positions", "q_merged_line", "q_line_page",
    "q_fuzzy_ratio", "q_fuzzy_tokens", "q_fuzzy_lev", "q_token_set", "q_partial", "q_score_lines", "q_best_block",
    "q_hit_stats", "q_hit_order", "q_embedded", "q_embedded_lines", "q_hybrid", "q_priority", "q_highlight",
    "d_grid", "d_greedy", "l_reading_order", "l_lines", "l_lines_tight", "l_paragraphs", "l_pages", "l_readable",
    "l_prompt", "f_label_value", "f_dynamic", "f_dynamic_documents", "f_standalone", "f_keyword", "f_state",
    "f_queue", "r_completions", "f_progress", "f_unknown", "f_merge", "f_align", "f_answers", "f_corrections", "f_known_priority",
    "v_checks", "v_verdicts", "v_messages", "v_summary", "v_verify_only", "o_filter", "o_polygons", "o_pick", "o_needs",
    "o_merge", "o_route", "c_catalog", "c_errors", "c_accepted", "c_deferred", "c_folder", "c_numbered", "c_checks_parse",
    "c_reply_parse", "r_latest", "t_normalise", "t_labels", "t_casts",
]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
