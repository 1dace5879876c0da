"""Cutting texts into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SIZE, OVERLAP = 500, 100
#: Ways to cut: windows of `size` characters that start every size - overlap, or by split_text.
SPLITTERS = ("windows", "recursive")


def _check(size: int, overlap: int, splitter: str) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    if splitter not in SPLITTERS:
        raise ValueError(f"unknown splitter {splitter}; there are {', '.join(SPLITTERS)}")


def _windows(text: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / (size - overlap))).cast("int")


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, splitter: str = "windows") -> Column:
    """Array of a text's chunks; an empty text has one empty chunk."""
    _check(size, overlap, splitter)
    if splitter == "windows":
        return F.transform(F.sequence(F.lit(0), _windows(text, size, overlap) - 1), lambda k: F.substring(text, k * (size - overlap) + 1, F.lit(size)))

    ship()

    @F.arrow_udf("array<string>")
    def split(col):
        import pyarrow as pa

        return pa.array([None if x is None else split_text(x, size, overlap) for x in col.to_pylist()], pa.list_(pa.string()))

    return split(text)


def chunk_count(text: Column, size: int = SIZE, overlap: int = OVERLAP, splitter: str = "windows") -> Column:
    return _windows(text, size, overlap) if splitter == "windows" else F.size(chunks(text, size, overlap, splitter))


def chunk_texts(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, splitter: str = "windows") -> DataFrame:
    """A row per chunk: chunk_idx from 0 and chunk_text; a null text gives none, other columns are repeated."""
    t = F.col(f"`{text}`")
    return df.where(t.isNotNull()).select(*[F.col(f"`{c}`") for c in df.columns if c != text], F.posexplode(chunks(t, size, overlap, splitter)).alias("chunk_idx", "chunk_text"))


#: What ends paragraphs, lines, sentences and words, coarsest first.
ENDS = (("\n\n",), ("\n",), (". ", "! ", "? "), (" ",))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `size` characters that end, where they can, behind a paragraph, else a line, a sentence or a word.

    The next chunk begins `overlap` characters before that end, at the first word there.  A cut leaves more than the overlap,
    so each chunk is ahead of the one before.
    """
    out, at = [], 0
    while len(text) - at > size:
        window = text[at : at + size]
        ends = (max((i + len(e) for e in kind if (i := window.rfind(e)) >= 0), default=0) for kind in ENDS)
        cut = next((e for e in ends if e > overlap), size)
        out.append(window[:cut])
        back = window[cut - overlap : cut]
        word = min((i + 1 for c in " \n" if (i := back.find(c)) >= 0), default=0)
        at += cut - overlap + word
    return [*out, text[at:]]
