"""Column expressions on arrays of doubles, numbers and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Cosine similarity; norms below `floor` count as `floor`."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def written(pattern: str, *numbers: Column) -> Column:
    """Numbers as C's printf writes them: what is rounded is the binary number itself, and exact halves go to the even digit. Spark's own formats round
    the shortest decimal form, halves up. Null where a number is."""

    @F.udf(StringType(), useArrow=True)
    def write(*values):
        return None if None in values else pattern % values

    return write(*[c.cast("double") for c in numbers])


def short_number(s: Column) -> Column:
    """A number to six significant digits, as C's %g writes it: no trailing zeros, an exponent below 1e-4 and from 1e6 on."""
    return written("%g", s)


def severity_tag(s: Column) -> Column:
    """A number to six significant digits, with p for the point: 0.5 is 0p5, 8.0 is 8."""
    return F.replace(short_number(s), F.lit("."), F.lit("p"))


def thousands(n: Column) -> Column:
    """A whole number with a comma between its thousands."""
    return F.format_number(n, 0)


def utc_stamp(t: Column) -> Column:
    """A moment as a log line has it: to the second, in UTC whatever the session's zone."""
    there = F.to_utc_timestamp(t, F.current_timezone())
    return F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fixed_width(c: Column, width: int) -> Column:
    """Right-aligned in at least so many characters; longer ones stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.-]", "_")


def seeded(key: Column, seed: int) -> Column:
    """A key for sampling and shuffling that any engine can compute: the MD5 of `key/seed`."""
    return F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))))


def seeded_number(key: Column, seed: int) -> Column:
    """The first 60 bits of `seeded`, as a long."""
    return F.conv(F.substring(seeded(key, seed), 1, 15), 16, 10).cast("long")
