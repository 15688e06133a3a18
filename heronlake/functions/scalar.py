"""Scalar functions as Column expressions, all evaluated by the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """x within 0 and 1; null stays null, which least() and greatest() alone would make the highest risk."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero for what is not negative; -1 stays -1."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def rounded(x: Column, digits: int) -> Column:
    """round() of a double as SQL engines have it that scale, round half away from zero and scale back. Spark's own rounds the shortest decimal
    form instead: 0.15325249999999998 gives 0.153252 there and 0.153253 here. For what is not negative."""
    scaled = x * float(10**digits)
    whole = F.floor(scaled).cast("double")
    return (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / float(10**digits)


def safe_divisor(x: Column) -> Column:
    """1 where x is null or 0: division by zero is an error in ANSI mode."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))


def fold_sum(terms: Sequence[Column]) -> Column:
    """Left to right, so that doubles add up the same everywhere."""
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return fold_sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def manhattan(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return fold_sum([F.abs(x - y) for x, y in zip(a, b, strict=True)])


def dot(a: Sequence[Column], b: Sequence[Column | float]) -> Column:
    return fold_sum([x * (F.lit(float(y)) if isinstance(y, int | float) else y) for x, y in zip(a, b, strict=True)])


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - array_dot(a, b) / safe_divisor(F.sqrt(array_dot(a, a)) * F.sqrt(array_dot(b, b)))


def quantize_i16(x: Column, half_even: bool = True) -> Column:
    """x * 32767, rounded (stored data half to even, queries half away from zero) and clipped."""
    scaled = x.cast("double") * 32767.0
    whole = F.bround(scaled) if half_even else F.round(scaled)
    return F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), whole)).cast("smallint")


def quantized(v: Column | str, half_even: bool = True) -> Column:
    return F.transform(v, lambda x: quantize_i16(x, half_even))


def hash_cell(vector: Sequence[Column], projection: Sequence[float], offset: float, width: float) -> Column:
    """floor((a . v + b) / w)."""
    return F.floor((dot(vector, projection) + offset) / width).cast("long")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole seconds as minutes."""
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60.0


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def merchant_id(number: Column) -> Column:
    return F.format_string("MERC-%03d", number)


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others with up to ten decimals and no trailing zeros."""
    decimals = F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(decimals)


def escape_html(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def duration_text(ms: Column) -> Column:
    """Milliseconds in the unit that fits: us, ms, s, or minutes and seconds."""
    minutes = F.floor(ms / 60000.0)
    return (
        F.when(ms < 1, F.concat(number_text(F.round(ms * 1000, 2)), F.lit("µs")))
        .when(ms < 1000, F.concat(number_text(F.round(ms, 2)), F.lit("ms")))
        .when(ms < 60000, F.concat(number_text(F.round(ms / 1000, 2)), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m"), F.floor((ms - minutes * 60000) / 1000).cast("string"), F.lit("s")))
    )


def bytes_text(n: Column) -> Column:
    """Bytes in the unit that fits, in steps of a thousand, cut to two decimals."""
    cut = lambda x: number_text(F.floor(x * 100) / 100)
    sized = F.concat(cut(n), F.lit(" B"))
    for power, unit in ((1, " kB"), (2, " MB"), (3, " GB"), (4, " TB")):
        sized = F.when(n >= 1000.0**power, F.concat(cut(n / 1000.0**power), F.lit(unit))).otherwise(sized)
    return sized


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 7)


def padded(value: Column, width: int, left: bool = True) -> Column:
    """Text of a column of a table: padded to a width, longer text as it is."""
    text = value.cast("string")
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text)))
    return F.concat(fill, text) if left else F.concat(text, fill)


def first_id(entries: Column, default: str | None = None) -> Column:
    """id of the first of an array of structs; the default where the array is null or empty."""
    return F.coalesce(F.get(entries, F.lit(0))["id"], F.lit(default))


def stamp_utc() -> Column:
    """The time of the query, in UTC whatever the session's zone, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def guarded(vector: Column, n: int, value: Column) -> Column:
    """value where the vector has n components or more and none of the first n is null; null otherwise."""
    whole = (F.size(vector) >= n) & F.forall(F.slice(vector, 1, n), lambda x: x.isNotNull())
    return F.when(whole, value)


def round_robin(number: Column, n: int) -> Column:
    return F.pmod(number - 1, F.lit(n))
