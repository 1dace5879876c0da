"""Text functions: Java-style trimming and tokens, source identities, fingerprints, names and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = r"[A-Za-z0-9]+|[\p{IsHan}&&[\x{0}-\x{FFFF}]]+"


def java_trim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (java_trim(c) == "")


def or_default(c: Column, default: str | Column) -> Column:
    return F.when(blank(c), default if isinstance(default, Column) else F.lit(default)).otherwise(c)


def tokenize(c: Column) -> Column:
    """ASCII letter-and-digit runs, lower-cased, and overlapping pairs of each run of Han characters (a single one stays).

    Runs are found before lower-casing, so no other letter becomes ASCII on the way; Han beyond the basic plane and
    everything else separates.  Order and repeats stay, null has no tokens.
    """
    text = F.coalesce(c, F.lit(""))
    # most texts have no Han: then what separates can be cut away, which is compiled where matching and lambdas aren't
    plain = F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), "[^a-z0-9]+"), "")
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).otherwise(pairs(r))))
    return F.when(text.rlike(r"\p{IsHan}"), mixed).otherwise(plain)


def normalize_source(c: Column) -> Column:
    """Trimmed and lower-cased, without scheme, fragment, leading www. and trailing slashes; null gives ''."""
    steps = ((r"(?s)^.*?://", ""), (r"(?s)#.*$", ""), (r"^www\.", ""), (r"/+$", ""))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(java_trim(F.coalesce(c, F.lit("")))))


def source_matches(a: Column, b: Column) -> Column:
    """Of two normalised sources: equal, or one ends in '/' and the other; empty ones match nothing."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)))


def source_of(url: Column, file_name: Column) -> Column:
    return F.when(~blank(url), url).when(~blank(file_name), file_name)


def fingerprint(text: Column) -> Column:
    return F.md5(text)


def chunk_id(key: Column, value: Column, index: Column) -> Column:
    """Version-3 UUID (without a namespace) of key|value#index."""
    h = F.md5(F.concat(key, F.lit("|"), value, F.lit("#"), index.cast("string")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def java_hash(c: Column) -> Column:
    """Unsigned 32-bit hash of an ASCII string, as Java's hashCode."""
    chars = F.split(c, "")
    return F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(0xFFFFFFFF))


def cache_file_name(url: Column) -> Column:
    """Safe name of a cached page: its readable part, 60 characters at most, and the hash of the URL."""
    safe = F.left(F.regexp_replace(url, "[^A-Za-z0-9]+", "_"), F.lit(60))
    return F.concat(safe, F.lit("_"), F.lower(F.hex(java_hash(url))), F.lit(".txt"))


def build_cache(url: Column, body: Column) -> Column:
    return F.concat(F.lit("source: "), url, F.lit("\n\n"), body)


def parse_cache(content: Column, requested: Column) -> tuple[Column, Column]:
    """(source, body) of a cached page; without a header the request's source and the whole content."""
    head = r"(?s)^source: ([^\n]*)\n\n(.*)$"
    has = content.rlike(head)
    return (F.when(has, java_trim(F.regexp_extract(content, head, 1))).otherwise(requested), F.when(has, F.regexp_extract(content, head, 2)).otherwise(content))


def short_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def table_cell(c: Column, width: int = 60) -> Column:
    """One line that a table can hold, cut to the width."""
    flat = java_trim(F.translate(F.coalesce(c, F.lit("")), "\n|", " /"))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("…"))).otherwise(flat)


def as_percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def as_decimal(c: Column) -> Column:
    return F.format_string("%.3f", c)


def as_delta(c: Column) -> Column:
    """Signed; '0' without a difference, '-' if unknown."""
    return F.when(c.isNull(), "-").when(F.abs(c) < 1e-9, "0").otherwise(F.format_string("%+.3f", c))


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss-SSS")


def long_hash(c: Column) -> Column:
    """Java's Long.hashCode."""
    folded = c.bitwiseXOR(F.shiftrightunsigned(c, 32)).bitwiseAND(0xFFFFFFFF)
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def avatar_bucket(user_id: Column, avatars: int = 4) -> Column:
    return F.abs(long_hash(user_id)) % avatars


def bad_username(c: Column) -> Column:
    """Shorter than 4 characters or with other characters than letters, digits and '_' or '#'."""
    return F.coalesce((F.length(c) < 4) | c.rlike("[^A-Za-z0-9_#]"), F.lit(True))


def bad_password(c: Column) -> Column:
    return F.coalesce(F.length(c) < 8, F.lit(True))


def bad_email(c: Column) -> Column:
    return F.coalesce(~F.contains(c, F.lit("@")), F.lit(True))
