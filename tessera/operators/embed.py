"""Vectors of texts: the interface that models take, and a stand-in that needs none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

DIMENSIONS = 256
# The characters of the Han script in the basic plane.
_HAN = "\u2e80-\u2e99\u2e9b-\u2ef3\u2f00-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufa6d\ufa70-\ufad9"
_RUN = re.compile(f"[A-Za-z0-9]+|[{_HAN}]+")


class Embedder(Protocol):
    """A model as a column function: text to array<double>, null where there is nothing to embed."""

    def embed(self, text: Column) -> Column: ...


@lru_cache(1 << 16)  # a worker's memory doesn't grow with the words that it meets
def _place(token: str, dimensions: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions


def tokens(text: str) -> list[str]:
    """As functions.text.tokenize."""
    out: list[str] = []
    for run in _RUN.findall(text):
        out += [run.lower()] if run.isascii() else [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


def hashed_terms(text: str | None, size: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of a text's tokens, hashed into dimensions, at length 1; null without tokens."""
    found = [_place(t, size) for t in tokens(text or "")]
    v = np.bincount(found, minlength=size).astype(np.float64)
    return v / np.sqrt(v @ v) if found else None


class HashedTerms:
    """hashed_terms() of texts.

    Offline and the same everywhere: texts that share words have an inner product, others none but by collisions.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        size = self.dimensions
        ship()

        @F.arrow_udf("array<double>")
        def vectors(col):
            import pyarrow as pa

            return pa.array((hashed_terms(x, size) for x in col.to_pylist()), pa.list_(pa.float64()))

        return vectors.asNondeterministic()(text)  # once a row, whatever filters it


class PythonEmbedder:
    """A function of a text; what it raises becomes that text's error, and its vector is null."""

    def __init__(self, function: Callable[[str], Sequence[float] | None]):
        self.function = function

    def said(self, text: Column) -> Column:
        """struct(vector, error)"""
        function = self.function
        ship()

        @F.arrow_udf("vector array<double>, error string")
        def vectors(col):
            import pyarrow as pa

            found, errors = [], []
            for x in col.to_pylist():
                try:
                    v = None if x is None else function(x)
                    found.append(None if v is None else [float(c) for c in v])
                    errors.append(None)
                except Exception as e:  # one text's failure is no other's
                    found.append(None)
                    errors.append(str(e) or type(e).__name__)
            return pa.StructArray.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["vector", "error"])

        return vectors.asNondeterministic()(text)  # once a row, whatever filters it

    def embed(self, text: Column) -> Column:
        return self.said(text)["vector"]


def said(embedder: Embedder, text: Column) -> Column:
    """struct(vector, error) of a text: a model that tells its errors does, one that doesn't has none."""
    if hasattr(embedder, "said"):
        return embedder.said(text)
    return F.struct(embedder.embed(text).alias("vector"), F.lit(None).cast("string").alias("error"))


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, vector) of the chunks that have a vector."""
    made = (embedder or HashedTerms()).embed(F.col(f"`{text_col}`"))
    return chunks.select(F.col(f"`{id_col}`").alias("chunk_id"), made.alias("vector")).where("vector is not null")
