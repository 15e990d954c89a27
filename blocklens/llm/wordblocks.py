"""Word tables of text blocks, the base of token counting and BPE encoding.

Texts are split at single spaces between two characters that are no blanks: places no token of either tokenizer
crosses. A task gathers whole texts into blocks of about ``BLOCK_CHARS`` characters. Of a block only its distinct
words travel, packed by a hash of the word into parts, so that all blocks' shares of a part meet in one task, where
each distinct word is encoded exactly once. A very frequent word costs one entry a block, not one an occurrence. The
codes return to their block, whose row holds the word numbers of every document; blocks are stored in buckets, so that
only the codes are moved to meet them.

Blocks are bounded by their characters (one longer text is a block of its own), a part by the number of parts, which
follows ``spark.sql.shuffle.partitions``."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import release, released, shared_folder

BLOCK_CHARS = 16_000_000
#: Rows turned into Python objects at once.
ROWS = 256
#: Only such a space parts two words; U+2581 stands for a space in one of the tokenizers.
BETWEEN = re.compile("(?<=[^\\s▁]) (?=\\S)")
_ASCII_BLANKS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_BLANKS = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

BLOCK_SCHEMA = ("kind string, block bigint, part int, ids array<bigint>, places array<bigint>, sizes array<bigint>, "
                "lens array<int>, n_words int, data binary, parts binary")


def _only_parting_spaces(text: str) -> bool:
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    blanks = _ASCII_BLANKS if text.isascii() else _ASCII_BLANKS + _OTHER_BLANKS
    if any(f" {c}" in text or f"{c} " in text for c in blanks):
        return False
    return text.isascii() or "▁ " not in text


def split_words(text: str) -> list[str]:
    """Words without the space that parts them; joined by one space they are the text again."""
    if not text:
        return []
    return text.split(" ") if _only_parting_spaces(text) else BETWEEN.split(text)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack_ints(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane: the high planes are nearly empty."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack(words: list[bytes]) -> bytes:
    lens = np.array([len(w) for w in words], "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(lens).tobytes() + b"".join(words), 3)


def unpack(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    lens = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    ends = (np.cumsum(lens, dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends)]


def _block(number: int, docs: list[tuple[int | None, int | None, int, np.ndarray]], words: list[str], parts: int,
           summed: bool) -> dict:
    """Columns of one block: a ``docs`` row, and a ``words`` row for each part. Words are numbered by frequency."""
    lens = [len(d[-1]) for d in docs]
    flat = np.concatenate([d[-1] for d in docs])
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    number_of = np.empty(len(order), np.int32)
    number_of[order] = np.arange(len(order), dtype=np.int32)
    coded = [words[i].encode() for i in order.tolist()]
    part = np.array([xxhash.xxh64_intdigest(w) % parts for w in coded], np.int64)
    flat = number_of[flat]
    if summed:  # (word, frequency) pairs, the words by ascending distance
        seqs, at = [], 0
        for k, n in enumerate(lens):
            own, freq = np.unique(flat[at:at + n], return_counts=True)
            seqs += [np.diff(own, prepend=0), freq]
            at, lens[k] = at + n, len(own)
        flat = np.concatenate(seqs)
    rows = [("docs", number, -1, *([d[c] for d in docs] for c in range(3)), lens, len(words), pack_ints(flat),
             pack_ints(part))]
    by_part = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[by_part], prepend=-1, append=parts)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        chosen = by_part[a:b].tolist()
        rows.append(("words", number, int(part[chosen[0]]), None, None, None, None, b - a, pack([coded[i] for i in chosen]),
                     None))
    return dict(zip((c.split()[0] for c in BLOCK_SCHEMA.split(", ")), zip(*rows)))


_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("places", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())),
                    ("n_words", pa.int32()), ("data", pa.binary()), ("parts", pa.binary())])


def _gather(inner_prefix: str, parts: int, block_chars: int, summed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        inner, first, docs, chars = _Numbers(), _Numbers(), [], 0

        def flush():
            words = [inner_prefix + w for w in inner] + list(first)
            if inner_prefix:
                for *_, seq in docs:
                    seq[:1] += len(inner)
            inner.clear()
            first.clear()
            return pa.RecordBatch.from_pydict(_block((task << 32) | made, docs, words, parts, summed), schema=_ARROW)

        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for doc_id, place, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                text = text or ""
                words = split_words(text)
                seq = list(map(inner.__getitem__, words[1:] if inner_prefix else words))
                if inner_prefix and words:
                    seq.insert(0, first[words[0]])
                docs.append((doc_id, place, len(text) if text.isascii() else len(text.encode()), np.array(seq, np.int32)))
                chars += len(text)
                if chars >= block_chars:
                    yield flush()
                    made += 1
                    docs, chars = [], 0
        if docs:
            yield flush()

    return released(run)


def word_blocks(docs: DataFrame, id_col: str, text_col: str, *, inner_prefix: str = "", summed: bool = False,
                parts: int | None = None, block_chars: int = BLOCK_CHARS, place_col: str | None = None) -> DataFrame:
    """The stored block table. ``inner_prefix`` is put before every word but the first of a text, which is then told
    apart from the others; ``summed`` keeps word frequencies of a document in place of its word sequence. A number in
    ``place_col`` stays with its document."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = (F.col(place_col) if place_col else F.lit(None)).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), place.alias("_place"),
                       F.col(text_col).cast("string").alias("_text"))
    name = f"blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(_gather(inner_prefix, parts, block_chars, summed), BLOCK_SCHEMA).write.bucketBy(parts, "block")
     .option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


CODE_SCHEMA = "block bigint, part int, n_words int, data binary"
_CODES = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n_words", pa.int32()), ("data", pa.binary())])


def coded_words(blocks: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]]) -> DataFrame:
    """``block, part, n_words, data``: the codes of a part's words in place of the words. ``encode()`` is called in
    each task and gives the function that encodes a list of words; it gets each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, known = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                coder = coder or encode()
                if row["part"] != at:
                    at, known = row["part"], {}
                words = unpack(row["data"], row["n_words"])
                new = list({w for w in words if w not in known})
                known.update(zip(new, coder([w.decode() for w in new])))
                yield pa.RecordBatch.from_pylist([row | {"data": pack([known[w] for w in words])}], schema=_CODES)

    words = blocks.where("kind = 'words'").select("block", "part", "n_words", "data")
    return words.repartition("part").sortWithinPartitions("part").mapInArrow(released(run), CODE_SCHEMA)


def finish_blocks(blocks: DataFrame, codes: DataFrame, finish: Callable[[tuple, list[bytes]], pd.DataFrame],
                  schema: str) -> DataFrame:
    """``finish(docs row, codes by word number)`` for every block, each a group of a bounded size."""
    docs = blocks.where("kind = 'docs'").select("block", "ids", "places", "sizes", "lens", "data", "parts")

    def run(docs_rows: pd.DataFrame, code_rows: pd.DataFrame) -> pd.DataFrame:
        head = next(docs_rows.itertuples(index=False))
        by_part = [c for row in code_rows.sort_values("part").itertuples(index=False) for c in unpack(row.data, row.n_words)]
        codes_of = [b""] * len(by_part)
        for number, code in zip(np.argsort(unpack_ints(head.parts), kind="stable").tolist(), by_part):
            codes_of[number] = code
        rows = finish(head, codes_of)
        del codes_of, by_part
        release()
        return rows

    return docs.groupBy("block").cogroup(codes.groupBy("block")).applyInPandas(run, schema)
