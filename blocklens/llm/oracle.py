"""DuckDB twins of the registered queries, over the same tables."""

from __future__ import annotations

from blocklens.llm.license_scan import MAX_SHIFT, NOTICES, TEMPLATES

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _edited(phrase: str, tail: int) -> str:
    """A pattern of all texts that are one edit or none away from the phrase, its last words excepted."""
    words, forms = phrase.split(), {phrase}
    for i in range(len(words) - tail):
        head, rest = words[:i], words[i + 1:]
        forms |= {" ".join(head + rest), " ".join([*head, "[^ ]+", *rest])}
        forms.add(" ".join([*words[:i + 1], "[^ ]+", *rest]))
    return "(?:^| )(?:" + "|".join(sorted(forms)) + ")(?: |$)"


def _license_scan() -> str:
    known = " ".join(f"WHEN '{label}' THEN regexp_matches(t, '{_edited(p, tail)}')" for p, label, tail in NOTICES)
    names = ", ".join(f"'{label}'" for _, label, _ in NOTICES)
    rows = []
    for tid, t in enumerate(TEMPLATES):
        words = t.phrase.split()
        rows += [f"({tid}, '{t.label}', {t.base}, {len(words) - 1}, {i}, '{a}', '{b}')"
                 for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rf"""
WITH tpl(tid, label, base, n_pairs, tpos, w1, w2) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(range(len(ws))) AS p FROM w),
d AS (SELECT doc_id, tid, label, base, n_pairs, p - tpos AS diagonal, count(DISTINCT tpos) AS n,
             bit_or(1::BIGINT << tpos) AS mask
      FROM u JOIN tpl USING (w1, w2) GROUP BY ALL),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {MAX_SHIFT} THEN 1 ELSE 0 END AS brk FROM d
      WINDOW o AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM s),
v AS (SELECT doc_id, tid, label, base, span, count(*) FILTER (WHERE base AND n = n_pairs) AS places,
             min(diagonal) FILTER (WHERE base AND n = n_pairs) AS f,
             max(diagonal) FILTER (WHERE base AND n = n_pairs) AS l,
             bit_count(bit_or(mask)) / n_pairs AS coverage
      FROM r GROUP BY doc_id, tid, label, base, n_pairs, span),
a AS (SELECT doc_id, sum(places) AS n_base, min(f) AS first_word, max(l) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND places > 0), '')
               AS base_labels,
             max(coverage) AS score FROM v GROUP BY doc_id),
x AS (SELECT doc_id, array_to_string(ws, ' ') AS t, ws FROM w),
n AS (SELECT doc_id, array_to_string(list_filter([{names}], lambda l: CASE l {known} END), ',') AS own FROM x),
k AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(base_labels, '') || ',' ||
        coalesce(own, ''), ','), lambda l: l <> ''))), ',') AS labels FROM n LEFT JOIN a USING (doc_id))
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def all_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_DEDUP, "op9_license_scan": _license_scan(), "op10_line_dedup": LINE_DEDUP}
