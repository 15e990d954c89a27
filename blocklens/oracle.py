"""The registered queries in plain SQL over the driver tables."""

from __future__ import annotations

from .queries import CONCEPTS, DIGIT_QUERIES, PHRASES, TYPED, WORD_QUERIES

W = r"[\p{L}\p{N}\p{M}]"

LINES = """
bl AS (
  SELECT doc_id, CAST(ln // 22 + 1 AS BIGINT) AS page,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS block_seq, t AS text, length(t) AS n,
         CAST(72 AS DOUBLE) AS x0, CAST(60 + 30 * (ln % 22) AS DOUBLE) AS y0,
         CAST(72 + 5 * length(t) AS DOUBLE) AS x1, CAST(71 + 30 * (ln % 22) AS DOUBLE) AS y1
  FROM (SELECT doc_id, unnest(range(len(a))) AS ln, trim(unnest(a)) AS t
        FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE t <> '')"""


def words(pitch: int = 30) -> str:
    return f"""
wb AS (
  SELECT doc_id, CAST(r // 22 + 1 AS BIGINT) AS page, wn AS block_seq, text, r, k, x0,
         x0 + 5 * length(text) AS x1, CAST(60 + {pitch} * (r % 22) AS DOUBLE) AS y0,
         CAST(71 + {pitch} * (r % 22) AS DOUBLE) AS y1
  FROM (SELECT *, CAST(72 + coalesce(sum(5 * length(text) + 5) OVER (PARTITION BY doc_id, r ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x0
        FROM (SELECT doc_id, wn, wn // 10 AS r, wn % 10 AS k, text
              FROM (SELECT doc_id, unnest(range(len(a))) AS wn, unnest(a) AS text
                    FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS a
                          FROM documents)))))"""


FORMS = """
fb AS (
  SELECT doc_id, CAST(b.page AS BIGINT) AS page, CAST(seq AS BIGINT) AS block_seq, b.t AS text,
         CAST(72 AS DOUBLE) AS x0, CAST(b.y AS DOUBLE) AS y0,
         CAST(72 + 5 * length(b.t) AS DOUBLE) AS x1, CAST(b.y + 11 AS DOUBLE) AS y1
  FROM (SELECT o_orderkey AS doc_id, unnest(range(9)) AS seq, unnest([
    {'page': 1, 'y': 120, 't': 'Policy Number: POL-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')},
    {'page': 1, 'y': 160, 't': 'Member Name: ' || c_name},
    {'page': 1, 'y': 200, 't': 'Order Date:'},
    {'page': 1, 'y': 230, 't': strftime(o_orderdate, '%Y-%m-%d')},
    {'page': 1, 'y': 280, 't': 'Market Segment'},
    {'page': 1, 'y': 310, 't': c_mktsegment || ' segment'},
    {'page': 2, 'y': 100, 't': 'Signature: __________'},
    {'page': 2, 'y': 160, 't': lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0')},
    {'page': 2, 'y': 680, 't': 'Order Status: ' || o_orderstatus}]) AS b
  FROM orders JOIN customer ON o_custkey = c_custkey)),
ff AS (
  SELECT doc_id, page, block_seq AS field_seq, x0, y0, x1, y1, text,
    CASE block_seq WHEN 0 THEN 'policy_number' WHEN 1 THEN 'member_name' WHEN 3 THEN 'order_date'
      WHEN 4 THEN 'market_segment' WHEN 6 THEN 'signature' WHEN 7 THEN 'detected_' || text || '_p2_1'
      WHEN 8 THEN 'order_status' END AS field_id,
    CASE block_seq WHEN 3 THEN 'Order Date' WHEN 4 THEN 'Market Segment' WHEN 7 THEN ''
      ELSE trim(split_part(text, ':', 1)) END AS label,
    CASE block_seq WHEN 3 THEN text WHEN 4 THEN lead(text) OVER w WHEN 7 THEN text
      ELSE trim(split_part(text, ':', 2)) END AS value,
    CAST(CASE block_seq WHEN 0 THEN 0.87 WHEN 1 THEN 0.87 WHEN 3 THEN 0.819 WHEN 4 THEN 0.52 WHEN 6 THEN 0.4
      WHEN 7 THEN 0.62 WHEN 8 THEN 0.77 END AS DOUBLE) AS confidence,
    CASE block_seq WHEN 3 THEN 'label_next_plain' WHEN 4 THEN 'stacked_label_plain'
      WHEN 6 THEN 'label_placeholder' WHEN 7 THEN 'standalone_pattern' ELSE 'label_value' END AS detection,
    CASE block_seq WHEN 4 THEN lead(x1) OVER w ELSE x1 END AS bx1,
    CASE block_seq WHEN 4 THEN lead(y0) OVER w ELSE y0 END AS by0,
    CASE block_seq WHEN 4 THEN lead(y1) OVER w ELSE y1 END AS by1
  FROM fb WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq)),
fd AS (
  SELECT doc_id, page, field_seq, field_id, CASE WHEN field_seq = 7 THEN 'Detected: ' || text ELSE label END AS name,
         label, value, x0, by0 AS y0, bx1 AS x1, by1 AS y1, confidence, detection
  FROM ff WHERE field_id IS NOT NULL AND field_seq NOT IN (2, 5) AND field_seq <> 6)"""


def _q(items: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t}', '{t.lower()}')" for i, t in enumerate(items))
    return f"q AS (SELECT * FROM (VALUES {rows}) v(query_id, raw, low))"


def _whole(text: str, i: str, m: str) -> str:
    """Word boundaries around [i, i + m), 0-based."""
    return (f"(NOT regexp_matches(CASE WHEN {i} > 0 THEN substr({text}, {i}, 1) ELSE '' END, '{W}') "
            f"AND NOT regexp_matches(substr({text}, {i} + {m} + 1, 1), '{W}'))")


def _snip(text: str, i: str, m: str, around: int) -> str:
    return (f"substr(substr({text}, greatest({i} - {around}, 0) + 1, "
            f"{i} + {m} + {around} - greatest({i} - {around}, 0)), 1, 200)")


def _exact_ctes(items: list[str]) -> str:
    return f"""{LINES}, {_q(items)},
ex AS (
  SELECT *, {_whole('text', 'i', 'm')} AS whole
  FROM (SELECT bl.*, query_id, instr(lower(text), low) - 1 AS i, length(raw) AS m
        FROM bl, q WHERE contains(lower(text), low))),
hit AS (
  SELECT doc_id, page, block_seq, CAST(query_id AS BIGINT) AS query_id, x0 + (x1 - x0) * (i / n) AS x0, y0,
         x0 + (x1 - x0) * ((i + m) / n) AS x1, y1, {_snip('text', 'i', 'm', 10)} AS snippet, 'ocr' AS source,
         CASE WHEN whole THEN 'exact' ELSE 'exact_loose' END AS match_type
  FROM ex WHERE whole OR m >= 3)"""


HIT = "doc_id, page, query_id, x0, y0, x1, y1, snippet, source, match_type"


def q_exact() -> str:
    return f"WITH {_exact_ctes(WORD_QUERIES)} SELECT {HIT} FROM hit WHERE match_type = 'exact'"


def q_many() -> str:
    texts = """qt AS (SELECT item_id, unnest(string_split(text, '. ')) AS raw,
  unnest(range(len(string_split(text, '. ')))) AS n FROM benchmark),
q AS (SELECT item_id * 100000 + n AS query_id, trim(raw) AS raw, lower(trim(raw)) AS low FROM qt WHERE trim(raw) <> '')"""
    ctes = _exact_ctes(["x"]).replace(_q(["x"]), texts)
    return f"WITH {ctes} SELECT {HIT} FROM hit WHERE match_type = 'exact'"


def q_table() -> str:
    """Words are single blocks; a page is one line. Stages: word (exact, loose, digits), then phrase, phrase without
    blanks, digits over the page."""
    typed = ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(TYPED))
    digit_at = "list_filter(range(1, length({0}) + 1), lambda p: regexp_matches(substr({0}, p, 1), '\\d'))"
    return f"""WITH {words(15)},
qt AS (SELECT item_id, unnest(string_split(text, '. ')) AS raw, unnest(range(len(string_split(text, '. ')))) AS n FROM benchmark),
q AS (SELECT query_id, raw, lower(raw) AS low, norm, replace(norm, ' ', '') AS g, regexp_replace(raw, '\\D', '', 'g') AS d,
        NOT contains(raw, ' ') AS single
      FROM (SELECT query_id, raw, {NORM.format('raw')} AS norm FROM (
        SELECT item_id * 100000 + n AS query_id, trim(raw) AS raw FROM qt
        UNION ALL SELECT * FROM (VALUES {typed}) v(query_id, raw)) WHERE raw <> '') WHERE norm <> ''),
nw AS (SELECT *, length(text) AS n, {NORM.format('text')} AS nt, regexp_replace(text, '\\D', '', 'g') AS ds FROM wb),
b1 AS (SELECT doc_id, page, query_id, text, n, x0, x1, y0, y1, instr(lower(text), low) - 1 AS i, length(raw) AS m
       FROM nw, q WHERE NOT contains(low, ' ') AND contains(lower(text), low)),
b2 AS (SELECT *, {_whole('text', 'i', 'm')} AS whole FROM b1),
dq AS (SELECT *, '(?s)^((?:.*?\\D)??)(' || array_to_string(string_split(d, ''), '\\D*') || ')(?:\\D|$)' AS pat FROM q WHERE length(d) >= 2),
b3 AS (SELECT doc_id, page, query_id, text, n, x0, x1, y0, y1, length(regexp_extract(text, pat, 1)) AS i,
         length(regexp_extract(text, pat, 2)) AS m FROM nw, dq WHERE ds <> '' AND regexp_matches(text, pat)),
bh AS (
  SELECT doc_id, page, query_id, x0 + (x1 - x0) * (i / n) AS x0, y0, x0 + (x1 - x0) * ((i + m) / n) AS x1, y1,
    {_snip('text', 'i', 'm', 10)} AS snippet, mt AS match_type, stage FROM (
    SELECT * EXCLUDE (whole), CASE WHEN whole THEN 'exact' ELSE 'exact_loose' END AS mt, CASE WHEN whole THEN 1 ELSE 2 END AS stage
    FROM b2 WHERE whole OR m >= 3
    UNION ALL SELECT *, 'digit_formatted', 3 FROM b3)),
pos AS (
  SELECT *, CAST(coalesce(sum(length(nt) + 1) OVER v, 0) AS BIGINT) AS s0, CAST(coalesce(sum(length(nt)) OVER v, 0) AS BIGINT) AS z0,
    CAST(coalesce(sum(length(ds)) OVER v, 0) AS BIGINT) AS d0
  FROM nw WINDOW v AS (PARTITION BY doc_id, page ORDER BY block_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ln AS (SELECT doc_id, page, string_agg(nt, ' ' ORDER BY block_seq) AS txt, string_agg(nt, '' ORDER BY block_seq) AS nsp,
         string_agg(ds, '' ORDER BY block_seq) AS dsp FROM pos GROUP BY ALL),
oq AS (SELECT ln.*, q.* FROM ln, q WHERE contains(nsp, g) OR (d <> '' AND contains(dsp, d))),
lq AS (SELECT * FROM oq WHERE NOT EXISTS (SELECT 1 FROM bh WHERE bh.doc_id = oq.doc_id AND bh.query_id = oq.query_id)),
m1 AS (SELECT doc_id, page, txt, query_id, 1 AS kind, CASE WHEN single THEN 'line_merged_word' ELSE 'line' END AS match_type,
         length(norm) AS m, CASE WHEN {_whole('txt', '(instr(txt, norm) - 1)', 'length(norm)')} THEN instr(txt, norm) - 1 ELSE
           list_min(list_filter(range(length(txt) - length(norm) + 1), lambda p: substr(txt, p + 1, length(norm)) = norm
             AND {_whole('txt', 'p', 'length(norm)')})) END AS i
       FROM lq WHERE contains(txt, norm) AND (length(norm) >= 2 OR NOT single)),
m2 AS (SELECT doc_id, page, txt, query_id, 2 AS kind, 'line_nospace' AS match_type, length(g) AS m, instr(nsp, g) - 1 AS i
       FROM lq WHERE length(g) >= 3 AND contains(nsp, g) AND {_whole('nsp', '(instr(nsp, g) - 1)', 'length(g)')}),
m3 AS (SELECT doc_id, page, txt, query_id, 3 AS kind, 'line_digits' AS match_type, length(d) AS m, instr(dsp, d) - 1 AS i
       FROM lq WHERE length(d) >= 2 AND contains(dsp, d)),
e3 AS (SELECT doc_id, page, query_id,
         bool_and(CASE WHEN i >= d0 THEN NOT regexp_matches(substr(' ' || text, da[i - d0 + 1], 1), '\\d') ELSE true END
           AND CASE WHEN i + m <= d0 + length(ds) THEN NOT regexp_matches(substr(text, da[i + m - d0] + 1, 1), '\\d') ELSE true END) AS ok
       FROM m3 JOIN (SELECT *, {digit_at.format('text')} AS da FROM pos WHERE ds <> '') p USING (doc_id, page)
       WHERE i < d0 + length(ds) AND i + m > d0 GROUP BY ALL),
mm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, query_id ORDER BY kind) AS rn FROM (
         SELECT * FROM m1 WHERE i IS NOT NULL UNION ALL SELECT * FROM m2
         UNION ALL SELECT m3.* FROM m3 SEMI JOIN (SELECT * FROM e3 WHERE ok) k USING (doc_id, page, query_id))),
cut AS (
  SELECT mm.doc_id, mm.page, query_id, match_type, kind, txt, text, x0, x1, y0, y1, length(nt) AS ln, ds, i, m,
    CASE kind WHEN 1 THEN s0 WHEN 2 THEN z0 ELSE d0 END AS o,
    CASE kind WHEN 3 THEN length(ds) ELSE length(nt) END AS k
  FROM mm JOIN pos USING (doc_id, page) WHERE rn = 1),
ab AS (SELECT *, greatest(i, o) - o AS a0, least(i + m, o + k) - o AS a1, {digit_at.format('text')} AS da FROM cut WHERE least(i + m, o + k) > greatest(i, o)),
lh AS (
  SELECT doc_id, page, query_id,
    min(x0 + (x1 - x0) * CASE kind WHEN 3 THEN (da[a0 + 1] - 1) / length(text) ELSE a0 / ln END) AS x0, min(y0) AS y0,
    max(x0 + (x1 - x0) * CASE kind WHEN 3 THEN da[a1] / length(text) ELSE a1 / ln END) AS x1, max(y1) AS y1,
    substr(any_value(txt), 1, 120) AS snippet, any_value(match_type) AS match_type, 4 AS stage
  FROM ab GROUP BY doc_id, page, query_id)
SELECT doc_id, page, query_id, x0, y0, x1, y1, snippet, 'ocr' AS source, match_type
FROM (SELECT *, min(stage) OVER (PARTITION BY doc_id, query_id) AS s FROM (SELECT * FROM bh UNION ALL SELECT * FROM lh)) WHERE stage = s"""


def q_batch() -> str:
    texts = ["Member Name", "BUILDING segment", "F"]
    ctes = _exact_ctes(texts).replace(LINES, FORMS + ", bl AS (SELECT *, length(text) AS n FROM fb)")
    return f"""WITH {ctes} SELECT {HIT}, {_NAME} AS filename FROM hit JOIN orders ON o_orderkey = doc_id
WHERE match_type = 'exact'"""


def q_exact_loose() -> str:
    return f"WITH {_exact_ctes(WORD_QUERIES)} SELECT {HIT} FROM hit WHERE match_type = 'exact_loose'"


def _digit_pattern(digits: str) -> str:
    return r"\D*".join(digits)


def q_digits() -> str:
    parts = []
    for i, d in enumerate(["".join(c for c in t if c.isdigit()) for t in DIGIT_QUERIES]):
        pat = f"(?s)^((?:.*?\\D)??)({_digit_pattern(d)})(?:\\D|$)"
        parts.append(f"""SELECT doc_id, page, CAST({i} AS BIGINT) AS query_id, text, x0 AS bx0, x1 AS bx1, y0, y1,
          length(text) AS n, length(regexp_extract(text, '{pat}', 1)) AS i,
          length(regexp_extract(text, '{pat}', 2)) AS m FROM fb WHERE regexp_matches(text, '{pat}')""")
    return f"""WITH {FORMS}, s AS ({' UNION ALL '.join(parts)})
SELECT doc_id, page, query_id, bx0 + (bx1 - bx0) * (i / n) AS x0, y0, bx0 + (bx1 - bx0) * ((i + m) / n) AS x1, y1,
  {_snip('text', 'i', 'm', 10)} AS snippet, 'ocr' AS source, 'digit_formatted' AS match_type FROM s"""


def _lcs(q: str, t: str) -> str:
    """Longest common subsequence of a literal and a column, bit-parallel."""
    bits: dict[str, int] = {}
    for i, c in enumerate(q):
        bits[c] = bits.get(c, 0) | (1 << i)
    full = (1 << len(q)) - 1
    case = "CASE c " + " ".join(f"WHEN '{c}' THEN {b}" for c, b in bits.items()) + " ELSE 0 END"
    seed = f"[CAST({full} AS BIGINT)]"
    chars = f"list_transform(string_split({t}, ''), lambda c: CAST({case} AS BIGINT))"
    left = (f"list_reduce(list_concat({seed}, {chars}), "
            f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})")
    return f"({len(q)} - bit_count({left}))"


def _lcs_ratio(q: str, t: str) -> str:
    total, lcs = f"({len(q)} + length({t}))", _lcs(q, t)
    return (f"CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST({total} - 2 * {lcs} AS DOUBLE) "
            f"/ CAST({total} AS DOUBLE))")


def _token_set(q: str, text: str, src: str, keep: str) -> str:
    """SELECT of ``keep`` and the token-set score of a literal against ``text`` (lower case). What the literal's tokens
    have beyond the text's is one of few strings, each with an alignment of its own."""
    own = sorted(set(q.split()))
    subsets = [" ".join(t for k, t in enumerate(own) if m >> k & 1) for m in range(1, 1 << len(own))]
    tokens = "[" + ", ".join(f"'{t}'" for t in own) + "]"
    share = lambda far, size: f"CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST({far} AS DOUBLE) / CAST({size} AS DOUBLE))"
    common = "CASE jb " + " ".join(f"WHEN '{r}' THEN {_lcs(r, 'ja')}" for r in subsets) + " ELSE 0 END"
    a, b = "(sect + gap + length(ja))", "(sect + gap + length(jb))"
    rests = share(f"(length(ja) + length(jb) - 2 * {common})", f"({a} + {b})")
    return f"""SELECT {keep}, CASE WHEN nt = 0 THEN 0 WHEN sect > 0 AND (ja = '' OR jb = '') THEN 100 WHEN sect = 0 THEN {rests}
    ELSE greatest({rests}, {share('(gap + length(ja))', f'(sect + {a})')}, {share('(gap + length(jb))', f'(sect + {b})')}) END AS score
  FROM (SELECT *, len(ta) AS nt, coalesce(array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains({tokens}, x))), ' '), '') AS ja,
      coalesce(array_to_string(list_filter({tokens}, lambda x: NOT list_contains(ta, x)), ' '), '') AS jb,
      coalesce(length(array_to_string(list_filter({tokens}, lambda x: list_contains(ta, x)), ' ')), 0) AS sect,
      CASE WHEN len(list_filter({tokens}, lambda x: list_contains(ta, x))) > 0 THEN 1 ELSE 0 END AS gap
    FROM (SELECT *, list_distinct(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '')) AS ta FROM {src}))"""


def q_token_set() -> str:
    return f"""WITH {LINES}, s AS ({_token_set('the and that', 'lower(text)', 'bl', 'doc_id, block_seq')})
SELECT doc_id, block_seq, score FROM s WHERE score >= 62"""


NORM = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"


def q_fuzzy_ratio() -> str:
    return f"""WITH {words()}, s AS (
  SELECT doc_id, block_seq, norm, {_lcs_ratio('thaner', 'norm')} AS score
  FROM (SELECT doc_id, block_seq, {NORM.format('text')} AS norm FROM wb) WHERE abs(length(norm) - 6) <= 4)
SELECT doc_id, block_seq, norm, score FROM s WHERE score >= 76"""


def _partial(q: str, t: str) -> str:
    """Best ratio of the shorter one against every window of the longer, shorter windows at its edges included."""
    m, n = len(q), f"length({t})"
    bits: dict[str, int] = {}
    for i, c in enumerate(q):
        bits[c] = bits.get(c, 0) | (1 << i)
    case = "CASE c " + " ".join(f"WHEN '{c}' THEN {b}" for c, b in bits.items()) + " ELSE 0 END"

    def left(text: str, seed: str) -> str:
        masks = f"list_transform(string_split({text}, ''), lambda c: CAST(({case}) & {seed} AS BIGINT))"
        return (f"bit_count(list_reduce(list_concat([CAST({seed} AS BIGINT)], {masks}), "
                f"lambda v, b: ((v + (v & b)) | (v - (v & b))) & {seed}))")

    def score(lcs: str, total: str) -> str:
        return (f"CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST({total} - 2 * ({lcs}) AS DOUBLE) / CAST({total} AS DOUBLE))")

    w = f"substr({t}, greatest(p, 0) + 1, least(p + {m}, {n}) - greatest(p, 0))"
    over_t = score(f"{m} - {left(w, str((1 << m) - 1))}", f"({m} + length({w}))")
    size = f"(least(p + {n}, {m}) - greatest(p, 0))"
    wm = f"CAST((1 << least(p + {n}, {m})) - (1 << greatest(p, 0)) AS BIGINT)"
    over_q = score(f"{size} - {left(t, wm)}", f"({n} + {size})")
    return f"""greatest(
    CASE WHEN {n} >= {m} THEN list_max(list_transform(range({1 - m}, {n}), lambda p: {over_t})) ELSE 0 END,
    CASE WHEN {n} <= {m} THEN list_max(list_transform(range(1 - {n}, {m}), lambda p: {over_q})) ELSE 0 END)"""


def q_partial() -> str:
    return f"""WITH {words()}, s AS (SELECT doc_id, block_seq, text, {_partial('thaner', 'lower(text)')} AS score FROM wb)
SELECT doc_id, block_seq, text, score FROM s WHERE score >= 80"""


def q_score_lines() -> str:
    in_order = "array_to_string(list_sort(list_filter(string_split_regex(norm, '\\s+'), lambda x: x <> '')), ' ')"
    return f"""WITH {words()}, l AS (SELECT doc_id, page, min(block_seq) AS line_start, string_agg(text, ' ' ORDER BY block_seq) AS text
  FROM wb GROUP BY doc_id, page, r),
s AS (SELECT doc_id, page, line_start, {_partial('than the', 'norm')} AS partial, {_lcs_ratio('than the', 'sorted')} AS token_sort,
        contains(replace(norm, ' ', ''), 'thanthe') AS there
      FROM (SELECT *, {in_order} AS sorted FROM (SELECT *, {NORM.format('text')} AS norm FROM l)))
SELECT doc_id, page, line_start, partial, token_sort, CASE WHEN there AND partial >= 92 THEN 'fuzzy_line'
  WHEN there AND token_sort >= 86 THEN 'fuzzy_line_tokens' END AS match_type FROM s WHERE partial >= 80"""


def q_best_block() -> str:
    return f"""WITH {words()}, n AS (SELECT *, {NORM.format('text')} AS nt FROM wb WHERE length(text) >= 2),
s AS (SELECT *, min(block_seq) OVER (PARTITION BY doc_id, page, r) AS line_start FROM wb),
c AS (SELECT doc_id, page, r, block_seq, text, {_partial('thaner', 'nt')} AS p, {_lcs_ratio('thaner', 'nt')} AS q FROM n WHERE nt <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, r ORDER BY greatest(p, q) DESC, block_seq) AS rn FROM c WHERE p >= 84 OR q >= 82)
SELECT doc_id, page, line_start, block_seq, substr(b.text, 1, 120) AS text, greatest(p, q) AS score
FROM b JOIN (SELECT doc_id, block_seq, line_start FROM s) USING (doc_id, block_seq) WHERE rn = 1"""


def _tokens_cte(src: str, lower: bool = False) -> str:
    """Word tokens of each block with their 0-based position."""
    return f"""
tk AS (
  SELECT * EXCLUDE (tks, gaps), tks[k + 1] AS tok,
    length(list_aggregate(list_slice(gaps, 1, k + 1), 'string_agg', ''))
      + coalesce(length(list_aggregate(list_slice(tks, 1, k), 'string_agg', '')), 0) AS c0
  FROM (SELECT *, unnest(range(len(tks))) AS k
        FROM (SELECT *, regexp_extract_all(text, '{W}+') AS tks, string_split_regex(text, '{W}+') AS gaps FROM {src})))"""


def _fuzzy(items: list[tuple[int, str]], src: str) -> str:
    parts = []
    for qid, q in items:
        n = len(q)
        need = 76 if n <= 5 else 82 if n <= 7 else 90
        parts.append(f"""SELECT *, {qid} AS query_id, {_lcs_ratio(q, 'tn')} AS score, {need} AS need
          FROM (SELECT *, {NORM.format('tok')} AS tn FROM tk) WHERE length(tn) >= 2
          AND abs(length(tn) - {n}) <= {max(2, n // 2 + 1)}""")
    return f"""{_tokens_cte(src)},
fz AS (
  SELECT doc_id, page, block_seq, CAST(query_id AS BIGINT) AS query_id,
    x0 + (x1 - x0) * (c0 / n) AS x0, y0, x0 + (x1 - x0) * ((c0 + length(tok)) / n) AS x1, y1,
    {_snip('text', 'c0', 'length(tok)', 8)} AS snippet, 'ocr' AS source, 'fuzzy_block' AS match_type
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_seq, query_id ORDER BY k) AS rn
        FROM ({' UNION ALL '.join(parts)}) WHERE score >= need) WHERE rn = 1)"""


def q_fuzzy_tokens() -> str:
    return f"""WITH {LINES}, {_fuzzy([(0, 'thaner'), (1, 'etres'), (2, 'mentrelle')], 'bl')}
SELECT {HIT} FROM fz"""


def q_cascade() -> str:
    """Rows are 30 pt apart, so every block is its own line; a block holds one hit per query and stage."""
    line, ns = [], []
    for i, raw in enumerate(WORD_QUERIES):
        f, g = raw.lower(), raw.lower().replace(" ", "")
        mt = "line" if " " in raw else "line_merged_word"
        line.append(f"""SELECT *, {i} AS query_id, '{mt}' AS match_type, 1 AS kind, length(nt) AS ln, {len(f)} AS m,
          list_min(list_filter(range(length(nt) - {len(f)} + 1), lambda p: substr(nt, p + 1, {len(f)}) = '{f}'
            AND {_whole('nt', 'p', str(len(f)))})) AS i FROM nb WHERE contains(nt, '{f}')""")
        if len(g) >= 3:
            ns.append(f"""SELECT *, {i} AS query_id, 'line_nospace' AS match_type, 2 AS kind, length(nsp) AS ln,
              {len(g)} AS m, instr(nsp, '{g}') - 1 AS i FROM nb
              WHERE contains(nsp, '{g}') AND {_whole('nsp', f"(instr(nsp, '{g}') - 1)", str(len(g)))}""")
    fuzzy = [(i, r.lower()) for i, r in enumerate(WORD_QUERIES) if " " not in r and len(r) >= 3]
    # Several words: the words of the query are all among the block's, which scores 100.
    multi = []
    for i, raw in enumerate(WORD_QUERIES):
        if " " in raw:
            has = " AND ".join(f"list_contains(string_split(nt, ' '), '{w}')" for w in raw.lower().split())
            multi.append(f"""SELECT doc_id, page, block_seq, CAST({i} AS BIGINT) AS query_id, x0, y0, x1, y1,
              substr(text, 1, 120) AS snippet, 'ocr' AS source, 'fuzzy_block' AS match_type FROM nb
              WHERE contains(nsp, '{raw.lower().replace(' ', '')}') AND {has}""")
    dpat = f"(?s)^((?:.*?\\D)??)({_digit_pattern('10')})(?:\\D|$)"
    return f"""WITH {_exact_ctes(WORD_QUERIES)},
nb AS (SELECT *, regexp_replace(nt, '\\s+', '', 'g') AS nsp FROM (SELECT *, {NORM.format('text')} AS nt FROM bl)),
lm AS (SELECT * FROM ({' UNION ALL '.join(line + ns)}) WHERE i IS NOT NULL),
lh AS (
  SELECT doc_id, page, block_seq, CAST(query_id AS BIGINT) AS query_id, x0 + (x1 - x0) * (i / ln) AS x0, y0,
         x0 + (x1 - x0) * ((i + m) / ln) AS x1, y1, substr(nt, 1, 120) AS snippet, 'ocr' AS source, match_type
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_seq, query_id ORDER BY kind) AS rn FROM lm)
  WHERE rn = 1),
dh AS (
  SELECT doc_id, page, block_seq, CAST(4 AS BIGINT) AS query_id, x0 + (x1 - x0) * (i / n) AS x0, y0,
         x0 + (x1 - x0) * ((i + m) / n) AS x1, y1, {_snip('text', 'i', 'm', 10)} AS snippet, 'ocr' AS source,
         'digit_formatted' AS match_type
  FROM (SELECT *, length(regexp_extract(text, '{dpat}', 1)) AS i, length(regexp_extract(text, '{dpat}', 2)) AS m
        FROM bl WHERE regexp_matches(text, '{dpat}'))),
{_fuzzy(fuzzy, 'bl')},
allh AS (
  SELECT *, CASE match_type WHEN 'exact' THEN 1 ELSE 2 END AS stage FROM hit
  UNION ALL SELECT *, 3 FROM dh UNION ALL SELECT *, 4 FROM lh UNION ALL SELECT *, 5 FROM fz
  UNION ALL SELECT *, 5 FROM ({' UNION ALL '.join(multi)}))
SELECT {HIT} FROM (SELECT *, min(stage) OVER (PARTITION BY doc_id, query_id) AS s0 FROM allh) WHERE stage = s0"""


def q_boundary_positions() -> str:
    return f"""WITH {LINES} SELECT doc_id, block_seq, CAST(i AS BIGINT) AS idx FROM (
  SELECT doc_id, block_seq, lower(text) AS low, unnest(range(n - 2)) AS i FROM bl WHERE contains(lower(text), 'the'))
WHERE substr(low, i + 1, 3) = 'the' AND {_whole('low', 'i', '3')}"""


def _merged(pitch: int, line_key: str) -> str:
    """Phrases over the joined words of a line: first place on word boundaries, box of the words it covers;
    without blanks when there is none."""
    forms = []
    for i, raw in enumerate(PHRASES):
        mt = "line" if " " in raw else "line_merged_word"
        forms.append(f"({i}, '{raw}', '{raw.replace(' ', '')}', '{mt}')")
    first = "list_min(list_filter(range(length(full) - length(f) + 1), lambda p: substr(full, p + 1, length(f)) = f AND "
    return f"""WITH {words(pitch)},
nw AS (SELECT *, {NORM.format('text')} AS nt FROM wb),
pos AS (
  SELECT *, {line_key} AS line,
    coalesce(sum(length(nt) + 1) OVER v, 0) AS s0, coalesce(sum(length(nt)) OVER v, 0) AS z0
  FROM nw WINDOW v AS (PARTITION BY doc_id, {line_key} ORDER BY block_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ln AS (SELECT doc_id, line, min(page) AS page, string_agg(nt, ' ' ORDER BY block_seq) AS txt,
              string_agg(nt, '' ORDER BY block_seq) AS nsp FROM pos GROUP BY ALL),
f AS (SELECT * FROM (VALUES {', '.join(forms)}) v(query_id, f, g, mt)),
m1 AS (SELECT doc_id, line, page, txt, query_id, 1 AS kind, mt AS match_type, length(f) AS m,
         {first.replace('full', 'txt')} {_whole('txt', 'p', 'length(f)')})) AS i
       FROM ln, f WHERE contains(txt, f)),
m2 AS (SELECT doc_id, line, page, txt, query_id, 2 AS kind, 'line_nospace' AS match_type, length(g) AS m,
         instr(nsp, g) - 1 AS i FROM ln, f
       WHERE contains(nsp, g) AND {_whole('nsp', '(instr(nsp, g) - 1)', 'length(g)')}),
mm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, query_id ORDER BY kind) AS rn
       FROM (SELECT * FROM m1 WHERE i IS NOT NULL UNION ALL SELECT * FROM m2)),
cut AS (
  SELECT mm.*, x0, x1, y0, y1, length(nt) AS ln,
    greatest(i, CASE kind WHEN 1 THEN s0 ELSE z0 END) - CASE kind WHEN 1 THEN s0 ELSE z0 END AS a0,
    least(i + m, CASE kind WHEN 1 THEN s0 ELSE z0 END + length(nt)) - CASE kind WHEN 1 THEN s0 ELSE z0 END AS a1
  FROM mm JOIN pos USING (doc_id, line) WHERE rn = 1)
SELECT doc_id, page, CAST(query_id AS BIGINT) AS query_id, min(x0 + (x1 - x0) * (a0 / ln)) AS x0, min(y0) AS y0,
  max(x0 + (x1 - x0) * (a1 / ln)) AS x1, max(y1) AS y1, substr(any_value(txt), 1, 120) AS snippet, 'ocr' AS source,
  any_value(match_type) AS match_type
FROM cut WHERE a1 > a0 GROUP BY doc_id, page, line, query_id"""


def q_merged_line() -> str:
    return _merged(30, "r")


def q_line_page() -> str:
    return _merged(15, "page")


_ACCENTS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"


def _lev_score(t: str, q: str) -> str:
    """Edit distance counts bytes there, so letters beyond ASCII become one byte each first."""
    low = f"translate(lower({t}), '{_ACCENTS}', '{_ONE_BYTE}')"
    return (f"CASE WHEN lower({t}) = '{q}' THEN 100 ELSE CAST(floor(CAST(100 AS DOUBLE) * (1 - levenshtein({low}, '{q}') / "
            f"greatest(length({t}), {len(q)}, 1)) + CAST(0.5 AS DOUBLE)) AS BIGINT) END")


def q_fuzzy_lev() -> str:
    return f"""WITH {words()} SELECT * FROM (
  SELECT doc_id, block_seq, text, CAST({_lev_score('text', 'thaner')} AS BIGINT) AS score FROM wb) WHERE score >= 82"""


def q_hit_stats() -> str:
    return f"""WITH {_exact_ctes(WORD_QUERIES)}
SELECT query_id, count(DISTINCT doc_id) AS docs_with_hits, (SELECT count(*) FROM documents) AS docs_total,
  count(*) AS match_count FROM hit WHERE match_type = 'exact' GROUP BY query_id"""


def q_hit_order() -> str:
    return f"""WITH {_exact_ctes(['that'])}, o AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, page, y0, x0) - 1 AS hit_no, count(*) OVER () AS n
  FROM hit WHERE match_type = 'exact')
SELECT doc_id, page, query_id, hit_no, (hit_no - 1 + n) % n AS prev_no, (hit_no + 1) % n AS next_no, x0, y0 FROM o"""


def q_embedded() -> str:
    items = ["that", "thaner", "und der"]
    fuzzy = []
    for i, q in ((0, "that"), (1, "thaner")):
        fuzzy.append(f"""SELECT *, {i} AS query_id FROM tk WHERE length(tok) >= 2
          AND abs(length(tok) - {len(q)}) <= {max(2, len(q) // 2 + 1)} AND {_lev_score('tok', q)} >= 82""")
    return f"""WITH {LINES}, {_q(items)},
e AS (SELECT * FROM (SELECT bl.*, lower(text) AS low_t, query_id, length(low) AS m, low AS qlow,
        unnest(range(n - length(low) + 1)) AS c0 FROM bl, q WHERE contains(lower(text), low))
      WHERE substr(low_t, c0 + 1, m) = qlow AND {_whole('low_t', 'c0', 'm')}),
{_tokens_cte('bl')},
z AS (
  SELECT doc_id, page, query_id, text, n, x0, x1, y0, y1, c0, m, 'exact' AS match_type, 1 AS st FROM e
  UNION ALL SELECT doc_id, page, query_id, text, n, x0, x1, y0, y1, c0, length(tok), 'fuzzy_token', 3
  FROM ({' UNION ALL '.join(fuzzy)}))
SELECT doc_id, page, CAST(query_id AS BIGINT) AS query_id, x0 + (x1 - x0) * (c0 / n) AS x0, y0,
  x0 + (x1 - x0) * ((c0 + m) / n) AS x1, y1,
  substr(text, greatest(c0 - 12, 0) + 1, c0 + m + 12 - greatest(c0 - 12, 0)) AS snippet, 'embedded' AS source, match_type
FROM (SELECT *, min(st) OVER (PARTITION BY doc_id, page, query_id) AS s0 FROM z) WHERE st = s0"""


def q_embedded_lines() -> str:
    return f"""WITH {words()} SELECT doc_id, page, y1 AS line_start, count(*) AS n_items, min(x0) AS x0, max(x1) AS x1
FROM wb GROUP BY doc_id, page, y1"""


def q_priority() -> str:
    return f"""WITH {_exact_ctes(['that', '2024'])}, s AS (
  SELECT query_id, match_type, CASE WHEN doc_id % 2 = 0 THEN 'embedded' ELSE 'ocr' END AS source FROM hit
  WHERE match_type = 'exact')
SELECT query_id, source, match_type, CAST(CASE WHEN source = 'embedded' THEN CASE query_id WHEN 1 THEN 310 ELSE 400 END
  ELSE CASE query_id WHEN 1 THEN 420 ELSE 300 END END AS BIGINT) AS priority, count(*) AS n FROM s GROUP BY ALL"""


def q_highlight() -> str:
    return f"""WITH {_exact_ctes(['that'])}
SELECT doc_id, page, x0 * CAST(1.5 AS DOUBLE) AS "left", y0 * CAST(1.5 AS DOUBLE) AS top,
  greatest((x1 - x0) * CAST(1.5 AS DOUBLE), CAST(1 AS DOUBLE)) AS width,
  greatest((y1 - y0) * CAST(1.5 AS DOUBLE), CAST(1.35 AS DOUBLE)) AS height FROM hit WHERE match_type = 'exact'"""


def d_grid() -> str:
    return f"""WITH {_exact_ctes(['that', 'the'])}
SELECT doc_id, page, block_seq, query_id, x0, y0, x1, y1 FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, floor(x0 / 64), floor(y0 / 64), floor(x1 / 64), floor(y1 / 64)
    ORDER BY block_seq, query_id) AS rn FROM hit WHERE match_type = 'exact') WHERE rn = 1"""


def d_greedy() -> str:
    """Two nested words hit a line at most once each, and lines lie 30 pt apart: the later of the two stays only where it
    is neither in the same grid cell nor the same ink."""
    return f"""WITH {_exact_ctes(['that', 'hat'])},
o AS (SELECT *, row_number() OVER v AS rn, lag(x0) OVER v AS p0, lag(x1) OVER v AS p1 FROM hit WHERE match_type = 'exact_loose'
      WINDOW v AS (PARTITION BY doc_id, block_seq ORDER BY x0, x1)),
g AS (SELECT *, greatest(least(x1, p1) - greatest(x0, p0), 0) AS w, abs((x0 + x1) - (p0 + p1)) / 2 AS d,
        least(x1 - x0, p1 - p0) AS small, (x1 - x0) + (p1 - p0) AS total FROM o)
SELECT doc_id, page, x0, y0, x1, y1, match_type FROM g WHERE rn = 1 OR NOT (
  (floor(x0 / 8) = floor(p0 / 8) AND floor(x1 / 8) = floor(p1 / 8)) OR w / (total - w) >= 0.38
  OR (d <= 32 AND (w / small > 0.4 OR d < 14)))"""


def l_reading_order() -> str:
    return f"WITH {words()} SELECT doc_id, page, block_seq, text, x0, y0 FROM wb"


def l_lines() -> str:
    return f"""WITH {words()} SELECT doc_id, page, min(block_seq) AS line_start, count(*) AS n_blocks, min(x0) AS x0,
  min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, block_seq) AS text
FROM wb GROUP BY doc_id, page, r"""


def l_lines_tight() -> str:
    return f"""WITH {words(15)} SELECT doc_id, page, min(block_seq) AS line_start, count(*) AS n_blocks, min(x0) AS x0,
  min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, block_seq) AS text
FROM wb GROUP BY doc_id, page"""


STAMP = "upper(replace(text, ' ', '')) IN ('EXAMPLE','SAMPLE','DRAFT','COPY','CONFIDENTIAL','WATERMARK') AND length(text) <= 14"


def _paras(src: str) -> str:
    return f"""
pp AS (
  SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > 26 THEN 1 ELSE 0 END AS brk
  FROM {src} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_seq)),
pg AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY y0, block_seq) AS para FROM pp),
pa AS (SELECT doc_id, page, para, count(*) AS n_lines, min(y0) AS y0, max(y1) AS y1,
         string_agg(text, chr(10) ORDER BY y0, block_seq) AS text FROM pg GROUP BY doc_id, page, para),
pt AS (SELECT doc_id, page, count(*) AS paragraph_count, '--- Page ' || page || ' ---' || chr(10) || chr(10)
         || string_agg(text, chr(10) || chr(10) ORDER BY para) AS text FROM pa GROUP BY doc_id, page)"""


def l_paragraphs() -> str:
    return f"""WITH {LINES}, keep AS (SELECT * FROM bl WHERE NOT ({STAMP})), {_paras('keep')}
SELECT doc_id, page, n_lines, y0, y1, text FROM pa"""


def l_pages() -> str:
    return f"""WITH {LINES}, keep AS (SELECT * FROM bl WHERE NOT ({STAMP})), {_paras('keep')}
SELECT doc_id, page, paragraph_count, text FROM pt"""


def l_readable() -> str:
    return f"""WITH {words()}, keep AS (
  SELECT doc_id, page, min(block_seq) AS block_seq, y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0) AS text
  FROM wb WHERE NOT ({STAMP}) GROUP BY doc_id, page, y0), {_paras('keep')},
c AS (SELECT doc_id, count(*) AS line_count FROM keep GROUP BY 1)
SELECT doc_id, line_count, CAST(sum(paragraph_count) AS BIGINT) AS paragraph_count,
  trim(regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page), '\\n{{3,}}', chr(10) || chr(10), 'g'),
       '[ \\t]+', ' ', 'g')) AS full_text FROM pt JOIN c USING (doc_id) GROUP BY doc_id, line_count"""


def l_prompt() -> str:
    return f"""WITH {LINES}, p AS (
  SELECT doc_id, string_agg('p' || page || ' [' || CAST(x0 AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ','
    || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || '] ' || substr(text, 1, 200), chr(10) ORDER BY block_seq) AS b
  FROM bl GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(b) > 12000 THEN substr(b, 1, 12000) || chr(10) || '…(truncated)' ELSE b END AS prompt FROM p"""


FIELD = "doc_id, field_seq, field_id, name, label, value, page, x0, y0, x1, y1, confidence, detection"


def f_label_value() -> str:
    return f"""WITH {FORMS} SELECT doc_id, field_seq AS block_seq, page, field_id, label, value, confidence, detection
FROM ff WHERE field_seq IN (0, 1, 6, 8)"""


def f_dynamic() -> str:
    return f"WITH {FORMS} SELECT {FIELD} FROM fd"


def f_standalone() -> str:
    return f"WITH {FORMS} SELECT {FIELD} FROM fd WHERE field_seq = 7"


_STATE = """
st AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, field_seq) AS priority,
         'page' || page || '_' || CASE WHEN ((y0 + y1) / 2) / 792 < 0.34 THEN 'header'
           WHEN ((y0 + y1) / 2) / 792 < 0.67 THEN 'body' ELSE 'footer' END AS section FROM fd),
done AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'policy_number' WHEN 1 THEN 'unknown_field'
           ELSE 'order_status' END AS field_id FROM orders)"""


def f_state() -> str:
    return f"""WITH {FORMS}, {_STATE} SELECT doc_id, priority, page, field_id, value, section, 'pending' AS status,
  confidence, confidence < 0.7 AS needs_review FROM st"""


def f_queue() -> str:
    return f"""WITH {FORMS}, {_STATE}, o AS (
  SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.doc_id = st.doc_id AND done.field_id = st.field_id))
SELECT doc_id, priority, page, field_id, value, section FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, confidence DESC, section) AS rn FROM o) WHERE rn = 1"""


def f_progress() -> str:
    return f"""WITH {FORMS}, {_STATE} SELECT doc_id, count(*) - count(d) AS pending, count(d) AS completed,
  count(*) FILTER (confidence < 0.7) AS needs_review
FROM (SELECT st.*, done.field_id AS d FROM st LEFT JOIN done USING (doc_id, field_id)) GROUP BY doc_id"""


def r_completions() -> str:
    return f"WITH {FORMS}, {_STATE} SELECT DISTINCT doc_id, field_id FROM done"


def f_unknown() -> str:
    return f"WITH {FORMS}, {_STATE} SELECT doc_id, field_id FROM done WHERE field_id = 'unknown_field'"


def f_merge() -> str:
    return f"""WITH {FORMS} SELECT doc_id, field_id,
  CASE WHEN field_seq = 0 AND doc_id % 2 = 0 AND doc_id % 3 = 1 THEN replace(value, 'POL', 'PQL') ELSE value END AS value, label,
  CASE WHEN field_seq = 0 AND doc_id % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE confidence END AS confidence, detection,
  CASE WHEN field_seq = 0 AND doc_id % 2 = 0 THEN 'external' END AS source FROM fd"""


def f_align() -> str:
    return f"""WITH {FORMS} SELECT doc_id, page, block_seq, x0, y0, x1, y1,
  CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CASE WHEN doc_id % 3 = 1 THEN CAST(2 AS DOUBLE) / 24 ELSE 0 END) AS score
FROM fb WHERE block_seq = 0"""


def f_answers() -> str:
    return f"""WITH {FORMS} SELECT doc_id, page, 'policy_number' AS field_id,
  CASE WHEN doc_id % 3 = 1 THEN replace(trim(split_part(text, ':', 2)), 'POL', 'PQL') ELSE trim(split_part(text, ':', 2)) END AS value,
  x0, y0, x1, y1, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.75 END AS DOUBLE) AS confidence,
  'external' AS source FROM fb WHERE block_seq = 0"""


def f_corrections() -> str:
    return f"""WITH {FORMS} SELECT doc_id, page, field_id,
  CASE WHEN field_seq = 1 AND doc_id % 2 = 1 THEN 'Order Date:' ELSE value END AS value,
  CASE WHEN field_seq = 1 AND doc_id % 2 = 1 THEN CAST(200 AS DOUBLE) ELSE y0 END AS y0,
  CASE WHEN field_seq = 1 AND doc_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE confidence END AS confidence,
  field_seq = 1 AS gpt_validated FROM fd"""


def f_known_priority() -> str:
    return """SELECT field_id, CAST(p AS BIGINT) AS priority, n FROM (VALUES ('policy_number', 1), ('full_name', 2),
  ('date_of_birth', 3)) v(field_id, p), (SELECT count(*) AS n FROM orders)"""


_NAME = "'form-' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END"


def _checked(placeholders: bool) -> str:
    """``ck``: the best field of every form for every concept, scored by each of its texts."""
    rows = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CONCEPTS))
    scored = " UNION ALL ".join(_token_set(c.lower(), "t", "dt", f"{i} AS concept_seq, t") for i, c in enumerate(CONCEPTS))
    return f"""{FORMS}, cc AS (SELECT * FROM (VALUES {rows}) v(concept_seq, concept)),
fx AS (SELECT doc_id, field_seq, field_id, label, value, CASE WHEN field_seq = 7 THEN 'Detected: ' || text ELSE label END AS name
       FROM ff WHERE field_id IS NOT NULL AND field_seq NOT IN (2, 5) {'' if placeholders else 'AND field_seq <> 6'}),
ft AS (SELECT doc_id, field_seq, lower(trim(unnest([label, name, field_id]))) AS t FROM fx),
dt AS (SELECT DISTINCT t FROM ft WHERE t <> ''), sc AS ({scored}),
fs AS (SELECT doc_id, field_seq, concept_seq, max(score) AS score FROM ft JOIN sc USING (t) GROUP BY ALL),
bf AS (SELECT *, row_number() OVER (PARTITION BY doc_id, concept_seq ORDER BY score DESC, field_seq) AS rn FROM fs),
bk AS (SELECT o.doc_id, concept_seq, concept, coalesce(score, 0) AS score, field_seq
       FROM (SELECT o_orderkey AS doc_id, concept_seq, concept FROM orders, cc) o
         LEFT JOIN (SELECT * FROM bf WHERE rn = 1) b USING (doc_id, concept_seq)),
ck AS (SELECT doc_id, CAST(concept_seq AS BIGINT) AS concept_seq, concept, score,
         CASE WHEN score < 62 THEN 'not_found' WHEN value IS NULL OR regexp_replace(value, '[\\s_.-]', '', 'g') = '' THEN 'null_or_empty'
           ELSE 'ok' END AS status,
         CASE WHEN score >= 62 THEN field_id END AS matched_field_id,
         CASE WHEN score >= 62 THEN CASE WHEN label <> '' THEN label ELSE name END END AS matched_label,
         CASE WHEN score >= 62 THEN value END AS value
       FROM bk LEFT JOIN fx USING (doc_id, field_seq)),
nm AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 <> 0 AS good, {_NAME} AS filename FROM orders),
vd AS (SELECT doc_id, count(*) AS n_checks, count(*) FILTER (status <> 'ok') AS n_issues, bool_and(status = 'ok') AS all_ok
       FROM ck GROUP BY doc_id),
ms AS (SELECT doc_id, concept_seq, good, filename, filename || CASE status
         WHEN 'not_found' THEN ': no field matched for ''' || concept || ''' (fuzzy score ' || CAST(round_even(score, 0) AS BIGINT) || ' < 62.0)'
         ELSE ': ''' || concept || ''' matched ''' || matched_label || ''' but value is null or empty' END AS message
       FROM ck JOIN nm USING (doc_id) WHERE status <> 'ok')"""


def v_checks() -> str:
    return f"""WITH {_checked(True)} SELECT doc_id, concept_seq, concept, status, matched_field_id, matched_label, value,
  round(score, 1) AS match_score FROM ck"""


def v_verdicts() -> str:
    return f"WITH {_checked(True)} SELECT doc_id, n_checks, n_issues, all_ok FROM vd"


def v_messages() -> str:
    return f"WITH {_checked(True)} SELECT doc_id, concept_seq, message FROM ms"


def c_folder() -> str:
    return f"""WITH {_checked(True)} SELECT doc_id, concept_seq, filename, message, false AS is_error FROM ms WHERE good
UNION ALL SELECT NULL, NULL, filename, filename || ': ERROR — skipped — not a .pdf', true FROM nm WHERE NOT good"""


def v_summary() -> str:
    return f"""WITH {_checked(True)} SELECT count(*) AS pdf_count, CAST({len(CONCEPTS)} AS BIGINT) AS concepts_count,
  count(*) FILTER (all_ok) AS pdfs_all_ok, count(*) FILTER (NOT all_ok) AS pdfs_with_issues,
  CAST(sum(n_issues) AS BIGINT) AS issue_lines FROM vd"""


def v_verify_only() -> str:
    return f"""WITH {_checked(False)} SELECT count(*) AS total_uploaded, count(*) FILTER (good) AS processed_ok,
  count(*) FILTER (NOT good) AS failed_read_or_extract,
  count(*) FILTER (NOT good OR NOT all_ok) AS pdfs_with_missing_or_unmatched FROM vd JOIN nm USING (doc_id)"""


def _ocr() -> str:
    return f"""{words()},
ow AS (SELECT wb.*, e.engine, (doc_id * 7 + block_seq * 13) % 101 - 1 AS conf FROM wb,
         (VALUES (1), (2)) e(engine) WHERE e.engine = 1 OR block_seq % 3 = 0)"""


def o_filter() -> str:
    return f"""WITH {_ocr()} SELECT doc_id, page, CAST(engine AS BIGINT) AS engine, block_seq, text, x0, y0, x1, y1
FROM ow WHERE engine <> 1 OR conf >= 30"""


_PICK = """
ls AS (SELECT doc_id, page, coalesce(sum(length(text)) FILTER (engine = 1), 0) AS c1, count(*) FILTER (engine = 1) AS n1,
         coalesce(sum(length(text)) FILTER (engine = 2), 0) AS c2, count(*) FILTER (engine = 2) AS n2
       FROM ow WHERE engine <> 1 OR conf >= 10 GROUP BY ALL),
pk AS (SELECT doc_id, page, CASE WHEN NOT (c1 >= 78 AND n1 >= 10) AND n2 > 0 AND (c2 >= c1 * CAST(0.68 AS DOUBLE)
         OR n2 >= greatest(3, n1) OR (c2 > c1 * CAST(0.5 AS DOUBLE) AND n2 > n1)) THEN 2 WHEN n1 > 0 THEN 1
         WHEN n2 > 0 THEN 2 END AS engine FROM ls)"""


def o_pick() -> str:
    return f"""WITH {_ocr()}, {_PICK} SELECT doc_id, page, CAST(1 AS BIGINT) AS ocr_pass, CAST(engine AS BIGINT) AS engine
FROM pk WHERE engine IS NOT NULL"""


def o_polygons() -> str:
    return f"""WITH {words()} SELECT doc_id, page, block_seq, text, x0, y0, x1, y1 FROM wb WHERE block_seq % 2 = 0"""


def t_casts() -> str:
    return """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type
    WHEN 2 THEN user_id || 'x' END AS raw FROM events),
c AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg, c_name FROM customer)
SELECT event_id AS id, coalesce(TRY_CAST(raw AS BIGINT), 99) AS number, coalesce(TRY_CAST(raw AS DOUBLE), CAST(0 AS DOUBLE)) AS real,
  CAST(NULL AS BOOLEAN) AS is_title FROM e
UNION ALL SELECT -c_custkey - 1, NULL, NULL, regexp_matches(t, '^[A-Z][a-z]{2,}-[A-Z][a-z]{2,}$') AND length(t) <= 48
FROM (SELECT c_custkey, seg || '-' || CASE WHEN c_custkey % 3 = 0 THEN seg ELSE c_name END AS t FROM c)"""


def o_needs() -> str:
    return f"""WITH {LINES}, s AS (
  SELECT doc_id, page, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS page_chars,
    CAST(coalesce(sum(length(regexp_replace(text, '\\s+', '', 'g'))) FILTER (NOT (upper(text) IN ('EXAMPLE','SAMPLE',
      'DRAFT','COPY','CONFIDENTIAL','WATERMARK'))), 0) AS BIGINT) AS native_score FROM bl GROUP BY ALL)
SELECT doc_id, page, page_chars, native_score, page_chars < 200 OR native_score < 100 AS weak FROM s"""


def o_merge() -> str:
    return f"""WITH {_ocr()}, {_PICK}, o AS (SELECT ow.* FROM ow JOIN pk USING (doc_id, page, engine) WHERE engine <> 1 OR conf >= 10)
SELECT doc_id, page, block_seq, text, x0, y0, x1, y1, 'ocr' AS source FROM o
UNION ALL SELECT doc_id, page, block_seq, text, x0, y0, x1, y1, 'native' FROM wb WHERE NOT EXISTS (
  SELECT 1 FROM o WHERE o.doc_id = wb.doc_id AND o.page = wb.page AND o.y0 = wb.y0
    AND greatest(0, least(o.x1, wb.x1) - greatest(o.x0, wb.x0)) / ((o.x1 - o.x0) + (wb.x1 - wb.x0)
      - greatest(0, least(o.x1, wb.x1) - greatest(o.x0, wb.x0))) >= 0.32)"""


def o_route() -> str:
    noise = "upper(text) IN ('EXAMPLE','SAMPLE','DRAFT','COPY','CONFIDENTIAL','WATERMARK')"
    return f"""WITH {_ocr()}, {_PICK},
nd AS (SELECT doc_id, page, sum(length(text)) < 22 OR coalesce(sum(length(text)) FILTER (NOT {noise}), 0) < 20 AS weak
       FROM wb GROUP BY ALL),
ch AS (SELECT ow.* FROM ow JOIN pk USING (doc_id, page, engine) WHERE engine <> 1 OR conf >= 10)
SELECT doc_id, page, block_seq, text, 'ocr' AS source FROM ch SEMI JOIN (SELECT * FROM nd WHERE weak) w USING (doc_id, page)
UNION ALL SELECT doc_id, page, block_seq, text, 'native' FROM wb JOIN nd USING (doc_id, page)
WHERE NOT {noise} AND (NOT weak OR NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = wb.doc_id AND ch.page = wb.page))"""


def c_catalog() -> str:
    return f"""WITH {FORMS}, nf AS (SELECT doc_id, count(*) AS n FROM fd GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM fb GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(nf.n, 0) AS field_count, coalesce(nb.n, 0) AS block_count,
  {_NAME} AS filename, trim(o_orderpriority) AS transaction_type, o_orderstatus AS carrier, '' AS vertical,
  CASE WHEN nf.n > 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'pending' ELSE 'none' END AS hint
FROM orders LEFT JOIN nf ON nf.doc_id = o_orderkey LEFT JOIN nb ON nb.doc_id = o_orderkey"""


def c_errors() -> str:
    return f"""SELECT o_orderkey AS upload_index, {_NAME} AS filename, 'skipped — not a .pdf' AS detail
FROM orders WHERE o_orderkey % 7 = 0"""


def c_accepted() -> str:
    return f"""SELECT o_orderkey AS doc_id, o_orderkey AS upload_index, {_NAME} AS filename
FROM orders WHERE o_orderkey % 7 <> 0"""


def c_deferred() -> str:
    return f"""WITH {FORMS}, n AS (SELECT doc_id, count(*) AS n, max(value) AS v FROM fd GROUP BY 1)
SELECT o_orderkey AS doc_id, o_orderkey % 10 = 5 AS extraction_pending, CASE WHEN o_orderkey % 10 = 5 THEN 0 ELSE coalesce(n, 0) END AS n_fields,
  CASE WHEN o_orderkey % 10 <> 5 THEN v END AS last_value, CAST(NULL AS VARCHAR) AS detail FROM orders LEFT JOIN n ON doc_id = o_orderkey
UNION ALL SELECT -o_orderkey, NULL, NULL, NULL, 'not in session' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey <> 0"""


def c_numbered() -> str:
    return """SELECT page_id, row_number() OVER (ORDER BY lower(url), url, page_id) AS position, url AS name FROM pages"""


def c_checks_parse() -> str:
    return """WITH c AS (SELECT conv_id, turn, list_filter(list_transform(CASE turn % 3 WHEN 0 THEN [role, text]
    WHEN 1 THEN string_split(text, chr(10)) ELSE [text] END, lambda x: trim(x)), lambda x: x <> '') AS a FROM conversations)
SELECT conv_id, turn, unnest(range(len(a))) AS n, unnest(a) AS concept FROM c"""


def c_reply_parse() -> str:
    return """SELECT event_id AS doc_id, CAST(0 AS BIGINT) AS field_seq, event_type AS field_id,
  CAST(user_id AS VARCHAR) AS value, 'gpt' AS source FROM events"""


def r_latest() -> str:
    return """SELECT ts, event_type AS action, user_id AS doc_id, props AS detail FROM events
ORDER BY ts DESC, event_type, user_id, props LIMIT 50"""


def t_normalise() -> str:
    return f"""SELECT doc_id, {NORM.format('text')} AS norm, regexp_replace(text, '\\D', '', 'g') AS digits,
  CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS printable FROM documents"""


def t_labels() -> str:
    count = lambda pat: f"length(regexp_replace(text, '{pat}', '', 'g'))"
    label = (f"(n BETWEEN 2 AND 52 AND NOT contains(text, ':') AND {count('[^\\\\p{L}]')} >= 2 "
             f"AND {count('[^0-9]')} <= n * 0.6)").replace("\\\\", "\\")
    word = r"regexp_matches(text, '[\p{L}\p{N}_]')"
    empty = r"length(regexp_replace(text, '[\s_\-.]', '', 'g')) = 0"
    slug = "trim(regexp_replace(lower(text), '[^a-zA-Z0-9]+', '_', 'g'), '_')"
    return f"""WITH {LINES}, a AS (SELECT *, {label} AS is_label, {word} AS w, {empty} AS is_empty, {slug} AS s FROM bl)
SELECT doc_id, block_seq, CASE WHEN s = '' THEN 'field' ELSE substr(s, 1, 56) END AS slug, is_label,
  n BETWEEN 1 AND 500 AND NOT (n - length(replace(text, ':', '')) = 1 AND instr(text, ':') - 1 < 30)
    AND NOT (is_label AND n < 18) AND w AS is_value,
  n BETWEEN 1 AND 500 AND (is_empty OR (NOT (contains(substr(text, 1, 22), ':') AND n < 36)
    AND NOT (NOT contains(text, ' ') AND n <= 8 AND is_label) AND w)) AS is_stacked, is_empty,
  regexp_matches(text, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}$|^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS is_date,
  regexp_matches(text, '(?i)^(?:SUB|POL)[-\\s]?\\d{{4,12}}$|^[A-Z]{{2,4}}[-\\s]\\d{{4,14}}$|^\\d{{8,14}}$') AS is_id,
  {STAMP} AS is_stamp FROM a"""


def all_sql() -> dict[str, str]:
    from .queries import NAMES
    return {n: globals()[n]() for n in NAMES if n in globals() and callable(globals()[n])}
