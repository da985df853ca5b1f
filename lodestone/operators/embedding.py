"""Text to vectors through a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DIM = 64
#: Rows of an Arrow batch that are texts and vectors in Python at a time.
ROWS = 1024


def hashed_encoder(dim: int = DIM, n: int = 3) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes a deterministic encoder: signed hashed character n-grams of lower-cased words, unit length (zero without words)."""

    def make() -> Callable[[list[str]], np.ndarray]:
        known: dict[str, tuple[int, float]] = {}

        def slot(gram: str) -> tuple[int, float]:
            if len(known) > 1 << 18:
                known.clear()
            if gram not in known:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                known[gram] = (h % dim, 1.0 if h >> 63 else -1.0)
            return known[gram]

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for r, text in enumerate(texts):
                for w in re.findall(r"\w+", text.lower()):
                    w = f" {w} "
                    for i in range(max(1, len(w) - n + 1)):
                        k, sign = slot(w[i : i + n])
                        out[r, k] += sign
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return encode

    return make


def embed_chunks(chunks: DataFrame, make_encoder: Callable | None = None, batch: int = 32) -> DataFrame:
    """chunk_id, dense_embedding. See with_embeddings."""
    return with_embeddings(chunks.select("chunk_id", "content"), make_encoder, batch).select("chunk_id", "dense_embedding")


def with_embeddings(chunks: DataFrame, make_encoder: Callable | None = None, batch: int = 32) -> DataFrame:
    """chunks with dense_embedding, all columns passed through; the encoder is made once in each Python worker and gets batch texts at a time. Null text counts as empty."""
    make, at = make_encoder or hashed_encoder(), chunks.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = [t or "" for t in b.column(at).to_pylist()]
            rows = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float32()))], [*b.schema.names, "dense_embedding"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("dense_embedding", T.ArrayType(T.FloatType()))]))
