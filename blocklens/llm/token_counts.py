"""Token counts of whole texts by a SentencePiece model.

Pre-tokens are the words of :mod:`wordblocks`; a document is its pre-token frequencies. Each distinct pre-token is
encoded once, only its number of pieces is kept, and a document's count is the sum of frequency x pieces. No ids are
kept or moved. Splitting is exact for models without a piece that has U+2581 after another character, without white
space changes in the normaliser and with a dummy prefix; ``check_model`` verifies this."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm import wordblocks


def check_model(path: str) -> None:
    """Raises unless words can be encoded on their own."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec = model.normalizer_spec
    joined = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or joined:
        raise ValueError("this model's tokens can reach over the space between two words")


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *,
                 block_chars: int = wordblocks.BLOCK_CHARS) -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for each row of ``docs``, without begin and end tokens.

    Null counts as empty: 0 bytes, 0 tokens. Rows that repeat an id, or have none, are counted like others. Other
    columns are ignored; an empty table gives an empty result. ``model_path`` is a path on every executor."""
    check_model(model_path)
    blocks = wordblocks.word_blocks(docs, id_col, text_col, summed=True, block_chars=block_chars)

    def encode():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return lambda words: [len(ids).to_bytes(4, "little") for ids in model.encode(words, num_threads=1)]

    def finish(head, codes: list[bytes]) -> pd.DataFrame:
        pieces = np.frombuffer(b"".join(codes), np.uint32).astype(np.int64)
        data = wordblocks.unpack_ints(head.data)
        totals, at = [], 0
        for n in head.lens.tolist():
            words = np.cumsum(data[at:at + n])
            totals.append(int(pieces[words] @ data[at + n:at + 2 * n]))
            at += 2 * n
        return pd.DataFrame({"_id": pd.array(head.ids, dtype="Int64"), "n_bytes": head.sizes, "n_tokens": totals})

    out = wordblocks.finish_blocks(blocks, wordblocks.coded_words(blocks, encode), finish,
                                   "_id bigint, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
