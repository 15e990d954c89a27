"""Table shapes, as DDL. ``block_seq`` is the dense 0-based reading position inside a document."""

BOX = "x0 double, y0 double, x1 double, y1 double"
BLOCK = f"doc_id bigint, page int, block_seq bigint, text string, {BOX}, source string"
BLOCK_JSON = "doc_id bigint, text string, bbox array<double>, page int"
OCR_WORD = ("doc_id bigint, page int, engine int, ocr_pass int, dpi int, word_seq bigint, text string, "
            "conf int, left double, top double, width double, height double, "
            "scale_x double, scale_y double")
DOCUMENT = ("doc_id bigint, filename string, upload_index bigint, extraction_pending boolean, "
            "transaction_type string, carrier string, vertical string")
FIELD = (f"doc_id bigint, field_seq bigint, field_id string, name string, label string, value string, "
         f"page int, {BOX}, confidence double, detection string")
FIELD_STATE = FIELD + (", source string, status string, priority int, section string, "
                       "needs_review boolean, requires_verification boolean, gpt_validated boolean")
HIT = (f"doc_id bigint, query_id int, page int, {BOX}, snippet string, source string, "
       "match_type string")
CHECK = ("doc_id bigint, concept_seq int, concept string, status string, matched_field_id string, "
         "matched_label string, value string, match_score double")
ANSWER = "doc_id bigint, field_id string, value string, confidence string, source string"
CORRECTION = ("doc_id bigint, seq bigint, field_id string, value_ok boolean, suggested_value string, "
              "adjusted_confidence string")
REVIEW_LOG = "ts timestamp, action string, doc_id bigint, detail string"
EMBEDDED_ITEM = f"doc_id bigint, page int, item_seq bigint, text string, {BOX}, base_y double"
PAGE_HEIGHT = 792.0
