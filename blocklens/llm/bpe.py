"""BPE encoding and decoding on a table of distinct words.

Spark splits the texts into words and keeps, for each document, the numbers of its words in order. Each distinct word
is encoded once by the tokenizer; its ids return by word number and are laid out by position. Decoding looks every id
of a distinct word up in the id-to-piece table (one entry an id of the vocabulary, hence bounded) and lays the bytes
out in the same way."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm import wordblocks


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes take the characters from U+0100 on, in order."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def id_to_piece(tokenizer_path: str) -> list[bytes]:
    """Bytes of each id; special tokens are their own text."""
    from tokenizers import Tokenizer

    tok, table = Tokenizer.from_file(tokenizer_path), byte_of_char()
    pieces = []
    for i in range(tok.get_vocab_size()):
        piece = tok.id_to_token(i) or ""
        ok = i not in tok.get_added_tokens_decoder() and all(c in table for c in piece)
        pieces.append(bytes(table[c] for c in piece) if ok else piece.encode())
    return pieces


def _encoder(tokenizer_path: str):
    def encode():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would keep memory of their own
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.no_truncation()
        tok.no_padding()

        def run(words: list[str]) -> list[bytes]:
            out = []
            for at in range(0, len(words), 2_000):
                out += [np.array(e.ids, np.uint32).tobytes()
                        for e in tok.encode_batch_fast(words[at:at + 2_000], add_special_tokens=False)]
            return out

        return run

    return encode


class _Words:
    """Codes of a block's words by word number, laid out along a sequence of numbers."""

    def __init__(self, codes: list[bytes], pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(codes), np.uint32).astype(np.int32)
        self.count = np.array([len(c) // 4 for c in codes], np.int64)
        self.start = np.cumsum(self.count) - self.count
        ids = self.flat.tolist()
        spans = list(zip(self.start.tolist(), (self.start + self.count).tolist()))
        self.decimal = [",".join(map(str, ids[a:b])) for a, b in spans]
        self.piece = [b"".join([pieces[i] for i in ids[a:b]]) for a, b in spans]

    def ids(self, seq: np.ndarray) -> np.ndarray:
        n = self.count[seq]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[seq] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def decimals(self, seq: np.ndarray) -> bytes:
        return ",".join([self.decimal[w] for w in seq.tolist()]).encode()

    def text(self, seq: np.ndarray) -> str:
        return b"".join([self.piece[w] for w in seq.tolist()]).decode(errors="replace")


def _laid_out(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, block_chars: int, row, schema: str,
              place_col: str | None = None):
    """``row(words, seq)`` for each document, ``seq`` being its word numbers; last the number in ``place_col``."""
    pieces = docs.sparkSession.sparkContext.broadcast(id_to_piece(tokenizer_path))
    blocks = wordblocks.word_blocks(docs, id_col, text_col, inner_prefix=" ", block_chars=block_chars,
                                   place_col=place_col)

    def finish(head, codes: list[bytes]) -> pd.DataFrame:
        words = _Words(codes, pieces.value)
        seqs = np.split(wordblocks.unpack_ints(head.data), np.cumsum(head.lens)[:-1])
        out = pd.DataFrame([row(words, seq) for seq in seqs], columns=[c.split()[0] for c in schema.split(", ")])
        out.insert(0, "_id", pd.array(head.ids, dtype="Int64"))
        if place_col:
            out["_place"] = pd.array(head.places, dtype="Int64")
        return out

    out = wordblocks.finish_blocks(blocks, wordblocks.coded_words(blocks, _encoder(tokenizer_path)), finish,
                                   f"_id bigint, {schema}{', _place bigint' if place_col else ''}")
    return out.withColumnsRenamed({"_id": id_col} | ({"_place": place_col} if place_col else {}))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
           block_chars: int = wordblocks.BLOCK_CHARS, place_col: str | None = None) -> DataFrame:
    """``id_col, ids, decoded`` for each row of ``docs``: the token ids and the text decoded from them. ``place_col``,
    a whole number of the row, comes along as the last column.

    As the tokenizers library encodes the whole text without special tokens added, truncation or padding; special
    strings inside a text become their id. Null counts as empty: no ids, empty text. Rows that repeat an id, or have
    none, are encoded like others. Other columns are ignored; an empty table gives an empty result."""
    return _laid_out(docs, tokenizer_path, id_col, text_col, block_chars,
                     lambda words, seq: (words.ids(seq), words.text(seq)), "ids array<int>, decoded string", place_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
            block_chars: int = wordblocks.BLOCK_CHARS) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: what :func:`encode` gives, hashed where it arises."""
    def row(words: _Words, seq: np.ndarray):
        return (int(words.count[seq].sum()), hashlib.sha256(words.decimals(seq)).hexdigest(),
                hashlib.sha256(words.text(seq).encode()).hexdigest())

    return _laid_out(docs, tokenizer_path, id_col, text_col, block_chars, row,
                     "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` of any table of ids, one row for each of its rows: ids join the id-to-piece table and the
    pieces are laid out by position. Ids outside the vocabulary give nothing, null or empty lists an empty text."""
    spark = tokens.sparkSession
    pieces = spark.createDataFrame(list(enumerate(id_to_piece(tokenizer_path))), "_t int, _piece binary")
    rows = tokens.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, ids_col).alias("_row"),
                         F.posexplode_outer(ids_col).alias("_pos", "_t"))
    joined = rows.join(F.broadcast(pieces), "_t", "left").groupBy("_id", "_row", "_pos").agg(
        F.first("_piece").alias("_piece"), F.count(F.lit(1)).alias("_copies"))
    text = joined.groupBy("_id", "_row").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.hex("_piece").alias("h")))).alias("_p"),
        F.max("_copies").alias("_copies"))
    text = text.select("_id", F.explode(F.expr("array_repeat(1, int(_copies))")).alias("_c"),
                       F.unhex(F.concat_ws("", F.col("_p.h"))).alias("_bytes"))
    return text.select(F.col("_id").alias(id_col), F.decode(F.coalesce("_bytes", F.unhex(F.lit(""))), "UTF-8")
                       .alias("decoded"))
