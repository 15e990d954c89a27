"""Text expressions. Everything is a native Column, so blocks stay where they were dealt."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}\p{M}]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
NOT_WORD_AFTER = rf"(?!{WORD})"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS = r"[\s\x1c-\x1f]"

# Words that are page stamps, not body text.
STAMP_WORDS = ("example", "sample", "draft", "copy", "confidential", "watermark")
STAMP_MAX_CHARS = 14

# Patterns of dates and identifiers.
DATE_ALONE = (
    r"(?U)^\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s*$|^\s*\d{4}-\d{2}-\d{2}\s*$"
)
ID_ALONE = (
    r"(?iU)^\s*(?:SUB|POL)[-\s]?\d{4,12}\s*$"
    r"|^\s*[A-Z]{2,4}[-\s]\d{4,14}\s*$"
    r"|^\s*\d{8,14}\s*$"
)
DATE_INLINE = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
ID_INLINE = r"(?iU)\b(?:[A-Z]{2,4}[-\s]?)?\d{5,12}\b|\b(?:SUB|POL)[-\s]?\d{4,12}\b"
TITLE_HYPHEN = r"^[A-Z][a-z]{2,}-[A-Z][a-z]{2,}$"


def norm_text(s: str) -> str:
    """Accent-free, lower-case text with single spaces (driver side)."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", flat.lower()).strip()


def norm_nospace_text(s: str) -> str:
    return re.sub(r"\s+", "", norm_text(s))


def _decomposition_tables() -> tuple[str, str, str, dict[str, str], str, str]:
    """Per-character form of the normalisation, by rule over all characters: one-to-one
    replacements, characters that vanish, and characters that become several; then the replacements from U+20000 on."""
    src, dst, gone, many, far = [], [], [], {}, []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        c = chr(cp)
        flat = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if flat == c:
            continue
        if cp >= 0x20000:
            far.append((c, flat))
        elif not flat:
            gone.append(c)
        elif len(flat) == 1:
            src.append(c)
            dst.append(flat)
        else:
            many[c] = flat
    return "".join(src), "".join(dst), "".join(gone), many, "".join(c for c, _ in far), "".join(d for _, d in far)


_SRC, _DST, _GONE, _LETTERS, _FAR_SRC, _FAR_DST = _decomposition_tables()
_MANY = "".join(_LETTERS)
_HANGUL = r"[\x{AC00}-\x{D7A3}]"
#: Characters that become several are put together letter by letter; few become more than so many.
SHORT_LETTERS = 4
# A Hangul syllable is U+AC00 + (lead * 21 + vowel) * 28 + tail.
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.btrim(c, F.lit(SPACES))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", "")


def _is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _norm_native(c: Column) -> Column:
    flat = F.when(_is_ascii(c), c).otherwise(F.translate(c, _SRC + _GONE, _DST))
    return strip(collapse_spaces(F.lower(flat)))


def _letters(ch: Column, forms: dict[str, str]) -> Column:
    """The form of a character, one translation for each of its places; past the end of a form it drops the character."""
    longest_first = sorted(forms, key=lambda c: -len(forms[c]))
    at = lambda i: "".join(forms[c][i] for c in longest_first if len(forms[c]) > i)
    return F.concat(*[F.translate(ch, "".join(longest_first), at(i)) for i in range(len(forms[longest_first[0]]))])


def _expanded(c: Column) -> Column:
    """The text with each character that becomes several (ligatures, Hangul, ...) replaced by its letters."""
    short = {ch: f for ch, f in _LETTERS.items() if len(f) <= SHORT_LETTERS}
    long = {ch: f for ch, f in _LETTERS.items() if len(f) > SHORT_LETTERS}

    def one(ch: Column) -> Column:
        k = F.ascii(ch) - 0xAC00
        letter = lambda table, i: F.substring(F.lit(table), i.cast("int") + 1, F.lit(1))
        tail = F.when(k % 28 > 0, letter(_TAILS, k % 28 - 1)).otherwise("")
        return (F.when(_is_ascii(ch), ch)
                .when(k.between(0, 11171), F.concat(letter(_LEADS, F.floor(k / 588)), letter(_VOWELS, F.floor(k % 588 / 28)), tail))
                .when(F.translate(ch, "".join(short), "") == "", _letters(ch, short))
                .when(F.translate(ch, "".join(long), "") == "", _letters(ch, long)).otherwise(ch))

    return F.array_join(F.transform(F.split(c, ""), one), "")


def norm(c: Column) -> Column:
    """NFKD, no combining marks, lower, single spaces, trimmed. Only texts with characters that expand to several are
    taken apart."""
    rare = ~_is_ascii(c) & ((F.translate(c, _MANY, "") != c) | c.rlike(_HANGUL))
    flat = F.translate(_expanded(c), _SRC + _FAR_SRC + _GONE, _DST + _FAR_DST)
    return F.when(rare, strip(collapse_spaces(F.lower(flat)))).otherwise(_norm_native(c))


def with_norm(df: DataFrame, col: str, out: str = "norm") -> DataFrame:
    return df.withColumn(out, norm(F.col(col)))


def is_word_char(c: Column) -> Column:
    return c.rlike(WORD)


def char_at(text: Column, idx: Column) -> Column:
    """Character at 0-based ``idx``; empty outside the text."""
    return F.when(idx >= 0, F.substring(text, idx + 1, F.lit(1))).otherwise(F.lit(""))


def boundary_ok(text: Column, idx: Column, length: Column) -> Column:
    """The span starts and ends a run of word characters."""
    return ~is_word_char(char_at(text, idx - 1)) & ~is_word_char(char_at(text, idx + length))


def literal_pattern(s: str) -> str:
    """A pattern matching ``s`` exactly (Java syntax)."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", s, flags=re.ASCII) if s.isascii() else "".join(
        c if c.isalnum() or not c.isascii() or c.isspace() else "\\" + c for c in s)


def phrase_pattern(q: str) -> str:
    return f"{NOT_WORD_BEFORE}{literal_pattern(q)}{NOT_WORD_AFTER}"


def first_phrase_index(text: Column, q: str) -> Column:
    """0-based index of the first occurrence of ``q`` on word boundaries, else null."""
    pat = phrase_pattern(q)
    head = F.regexp_extract(text, f"(?s)^(.*?){pat}", 1)
    return F.when(F.contains(text, F.lit(q)) & text.rlike(pat), F.length(head))


def phrase_indices(text: Column, q: str) -> Column:
    """All 0-based indices, overlapping ones too, where ``q`` sits on word boundaries."""
    look = f"{NOT_WORD_BEFORE}(?={literal_pattern(q)}{NOT_WORD_AFTER})"
    return F.when(F.contains(text, F.lit(q)), _cut_points(text, look)).otherwise(
        F.array().cast("array<int>"))


def _cut_points(text: Column, look: str) -> Column:
    """Positions of a zero-width pattern: lengths of the pieces it cuts the text into."""
    pieces = F.split(text, look)
    lens = F.transform(pieces, F.length)
    inner = F.aggregate(
        F.slice(lens, 1, F.size(lens) - 1), F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    at_start = F.when(text.rlike("^" + look), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(at_start, inner)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def digits_only_text(s: str) -> str:
    return re.sub(r"\D", "", s)


def query_is_digit_only(q: str) -> bool:
    """At least two digits and no ASCII letter."""
    return len(digits_only_text(q)) >= 2 and not re.search(r"[A-Za-z]", q)


def _digit_class() -> str:
    """All characters that count as digits, superscripts and circled digits included."""
    codes = [c for c in range(0x80, 0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    firsts = [c for c in codes if c - 1 not in codes]
    lasts = [c for c in codes if c + 1 not in codes]
    extra = "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in zip(firsts, lasts, strict=True))
    return rf"\p{{Nd}}{extra}"


_DIGIT = _digit_class()
ASCII_DIGIT = "0-9"


def flexible_digits_pattern(digits: str, digit: str = _DIGIT) -> str:
    """The digits with any run of non-digits between them, not inside a longer digit run. ``digit`` is the class of
    characters that count as digits."""
    core = rf"[^{digit}]*".join(digits)
    return rf"(?<![{digit}]){core}(?![{digit}])"


def flexible_digits_span(text: Column, digits: str, digit: str = _DIGIT) -> Column:
    """struct(c0, c1) of the first flexible digit match, else null."""
    pat = flexible_digits_pattern(digits, digit)
    full = rf"(?s)^(.*?)({pat})"
    c0 = F.length(F.regexp_extract(text, full, 1))
    return F.when(text.rlike(pat), F.struct(
        c0.alias("c0"), (c0 + F.length(F.regexp_extract(text, full, 2))).alias("c1")))


def flexible_digits_spans(text: Column, digits: str, digit: str = _DIGIT) -> Column:
    """Every flexible digit match as array<struct<c0,c1>>, left to right without overlap."""
    core = rf"[^{digit}]*".join(digits)
    end = rf"(?![{digit}])"
    none = F.array().cast("array<struct<c0:int,c1:int>>")
    starts = _cut_points(text, rf"(?<![{digit}])(?={core}{end})")

    def add(acc: Column, p: Column) -> Column:
        rest = F.substring(text, p + 1, F.length(text))
        c1 = (p + F.length(F.regexp_extract(rest, f"^({core}){end}", 1))).cast("int")
        taken = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["c1"], F.lit(0)) > p)
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(p.alias("c0"), c1.alias("c1")))))

    return F.when(text.rlike(flexible_digits_pattern(digits, digit)),
                  F.aggregate(starts, none, add)).otherwise(none)


def has_flexible_digits(text: Column, digits: str) -> Column:
    """Whether ``flexible_digits_pattern`` stands in the text. Many texts hold no digit or only ASCII characters and are
    settled without the long class of all digits."""
    ascii_hit = text.rlike(flexible_digits_pattern(digits, ASCII_DIGIT))
    return F.when(_is_ascii(text), F.contains(text, F.lit(digits[:1])) & ascii_hit).otherwise(
        text.rlike(flexible_digits_pattern(digits)))


def is_digit_char(c: Column) -> Column:
    return c.rlike(f"[{_DIGIT}]")


def slug(c: Column, max_len: int = 56) -> Column:
    """Lower-case ASCII letters and digits joined by single underscores."""
    s = F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z0-9]+"), F.lit(0)), "_")
    return F.coalesce(F.nullif(F.substring(s, 1, max_len), F.lit("")), F.when(c.isNotNull(), "field"))


def looks_empty(c: Column) -> Column:
    """Nothing left without blanks, underscores, dashes and dots."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f_\-.]")


def missing_value(c: Column) -> Column:
    return c.isNull() | looks_empty(c)


def _n_digits(c: Column) -> Column:
    """Number of digits. The class of all digits is long, ASCII texts need only a part of it."""
    ascii_n = F.when(c.rlike("[0-9]"), F.length(F.regexp_replace(c, "[^0-9]+", ""))).otherwise(0)
    return F.when(_is_ascii(c), ascii_n).otherwise(F.length(F.regexp_replace(c, rf"[^{_DIGIT}]", "")))


def looks_like_label(t: Column) -> Column:
    """2..52 characters, no colon, two letters or more, digits at most 60 percent."""
    n = F.length(t)
    return (n.between(2, 52) & ~F.contains(t, F.lit(":"))
            & t.rlike(r"\p{L}\P{L}*+\p{L}")
            & (_n_digits(t) <= n * F.lit(0.6)))


def has_word(t: Column) -> Column:
    return t.rlike(r"[\p{L}\p{N}_]")


def looks_like_plain_value(t: Column) -> Column:
    n = F.length(t)
    colons = n - F.length(F.replace(t, F.lit(":"), F.lit("")))
    return (n.between(1, 500) & ~((colons == 1) & (F.instr(t, ":") - 1 < 30))
            & ~(looks_like_label(t) & (n < 18)) & has_word(t))


def stacked_value_ok(t: Column) -> Column:
    n = F.length(t)
    early = F.contains(F.substring(t, 1, 22), F.lit(":")) & (n < 36)
    one_label = ~F.contains(t, F.lit(" ")) & (n <= 8) & looks_like_label(t)
    return n.between(1, 500) & (looks_empty(t) | (~early & ~one_label & has_word(t)))


def looks_like_title_hyphen(t: Column) -> Column:
    return (F.length(t) <= 48) & t.rlike(TITLE_HYPHEN)


def is_date_alone(t: Column) -> Column:
    return t.rlike(DATE_ALONE)


def is_id_alone(t: Column) -> Column:
    return t.rlike(ID_ALONE)


def label_value_confidence(label: Column, value: Column) -> Column:
    """Base score plus bonuses, summed in a fixed order so that equal inputs round alike."""
    zero = F.lit(0.0)
    s = F.lit(0.72) + F.when(F.length(label) >= 3, F.lit(0.05)).otherwise(zero)
    s = s + F.when(value.rlike(DATE_ALONE) | value.rlike(DATE_INLINE), F.lit(0.12)).otherwise(zero)
    s = s + F.when(value.rlike(ID_INLINE), F.lit(0.1)).otherwise(zero)
    s = s + F.when(F.contains(value, F.lit("@")), F.lit(0.08)).otherwise(zero)
    return F.round(F.least(F.lit(1.0), s), 3)


def is_stamp(t: Column, *, drop_spaces: bool = False) -> Column:
    """A lone stamp word. ``drop_spaces`` also catches letter-spaced stamps."""
    u = F.lower(F.replace(t, F.lit(" "), F.lit(""))) if drop_spaces else F.lower(t)
    return u.isin(*STAMP_WORDS) & (F.length(t) <= STAMP_MAX_CHARS)


def printable_chars(c: Column) -> Column:
    return F.length(remove_spaces(F.coalesce(c, F.lit(""))))


def strip_duplicate_whitespace(c: Column) -> Column:
    few_lines = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(few_lines, r"[ \t]+", " "))


def snippet(text: Column, c0: Column, c1: Column, around: int, max_len: int = 200) -> Column:
    start = F.greatest(c0 - around, F.lit(0))
    return F.substring(F.substring(text, start + 1, c1 + around - start), F.lit(1), F.lit(max_len))


def parse_checks(c: Column) -> Column:
    """Checklist text to array<string>: a JSON list, a JSON string, else one concept per line."""
    s = strip(F.coalesce(c, F.lit("")))
    as_list = F.when(s.startswith("["), F.try_variant_get(F.try_parse_json(s), "$", "array<string>"))
    as_text = F.when(s.startswith('"'), F.array(F.try_variant_get(F.try_parse_json(s), "$", "string")))
    as_text = F.when(F.element_at(as_text, 1).isNotNull(), as_text)
    lines = F.split(s, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    got = F.coalesce(as_list, as_text, lines)
    return F.filter(F.transform(got, strip), lambda x: x.isNotNull() & (x != ""))


def parse_reply_objects(c: Column, element: str) -> Column:
    """The outermost ``[...]`` of a model reply as array<struct>; what is not an object drops out."""
    body = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    raw = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    objs = F.filter(raw, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(objs, lambda v: F.from_json(F.to_json(v), element))


def coerce_int(c: Column, default: int = 1) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def coerce_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def trim_label(c: Column, max_len: int = 200) -> Column:
    """Session label: trimmed, at most ``max_len`` characters, empty for null."""
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, max_len)
