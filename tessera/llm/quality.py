"""Host-level quality rules with an empirical beta prior.

Rules first judge each document by counts over its whole text.  Then failures are summed by host (here the
document's source), and each host's failure rate is shrunk towards the corpus.  The beta prior is found by moments: with m the
failure rate of all N documents, v the spread of the H hosts' rates around it (weighted by documents) and rho the part of it that
sampling doesn't explain, v N / m(1-m) = H + (N - H) rho, the strength is k = (1 - rho)/rho, kept within PRIOR_RANGE,
and a host with f failures of n documents has the rate (f + m k)/(n + k).  A host above `max_rate` is rejected, and the verdict is joined back to its
documents.  A few failing pages therefore don't condemn a small host, and clean documents of a host that
fails no more than others are kept.

Nulls: a null text has no words and fails; a null host is a host of its own.  Repeated rows count as
often as they occur.  Long texts are counted whole; carried columns travel in a struct, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Least and largest strength of the prior, in documents.
PRIOR_RANGE = (1.0, 1000.0)
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of the width that occur twice or more, first ones included."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    at = np.flatnonzero(np.fromiter((seen[g] > 1 for g in grams), bool, len(grams)))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def signals(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    tight = text.translate(None, _SPACE)
    chars = int(np.count_nonzero((np.frombuffer(tight, np.uint8) & 0xC0) != 0x80))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(tight) - len(tight.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_of(text):
    """Column of structs of COUNTS."""
    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(col: pa.Array) -> pa.Array:
        cols = list(zip(*map(signals, C.texts(col)))) or [()] * len(COUNTS)
        C.release()
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COUNTS))

    return count(text.cast("binary"))


def measure(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, counts): row is a struct of the carried columns, all by default."""
    C.ship(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row")
    return df.select(row, counts_of(F.col(f"`{text_col}`")).alias("_counts")).select("row", "_counts.*")


def base_rules(min_words: int = 10, max_repeat_percent: int = 20):
    """Failed by the document's own counts."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """(host, rate): failure rates of the hosts, shrunk by the prior; one row per host."""
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(failed).cast("long")).cast("double").alias("f"))
    overall = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), F.sum("n").alias("all_n"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"), F.count(F.lit(1)).cast("double").alias("h"))
    varied = (F.col("m") > 0) & (F.col("m") < 1) & (F.col("all_n") > F.col("h"))
    rho = ((F.col("ff") / F.col("all_n") - F.col("m") * F.col("m")) * F.col("all_n") / (F.col("m") * (1 - F.col("m"))) - F.col("h")) / (F.col("all_n") - F.col("h"))
    k = F.when(varied & (rho > 1e-12), F.least(F.greatest((1 - rho) / rho, F.lit(PRIOR_RANGE[0])), F.lit(PRIOR_RANGE[1]))).otherwise(PRIOR_RANGE[1])
    prior = overall.select("m", k.alias("k"))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select(host, ((F.col("f") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"))


def judge(measured: DataFrame, host: str, max_rate: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """measured (written, as it is read twice) with base_failed and kept; host: a column of its row."""
    judged = measured.withColumns({"base_failed": base_rules(min_words, max_repeat_percent), "_host": F.col(f"row.`{host}`")})
    rates = host_rates(judged.select(F.col("_host").alias("host"), F.col("base_failed").alias("failed")))
    joined = judged.join(rates, judged["_host"].eqNullSafe(rates["host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("rate"), F.lit(0.0)) <= max_rate)).drop("_host", "host", "rate")
