"""Null-safe scalar functions: NULL is the only nodata, and nodata in gives nodata out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def num(c: Column | str | float) -> Column:
    return col(c).cast("double")


def nodata(c: Column | str) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(num(c)), col(c))


def divide(a: Column | str | float, b: Column | str | float) -> Column:
    """a / b as double; a zero divisor gives nodata."""
    return F.try_divide(num(a), num(b))


def power(base: Column | str, p: float) -> Column:
    """base ** p; what isn't a real number gives nodata."""
    value = F.pow(num(base), F.lit(float(p)))
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def sqrt(x: Column | str) -> Column:
    return F.when(num(x) >= 0, F.sqrt(num(x)))


def ln(x: Column | str) -> Column:
    return F.when(num(x) > 0, F.ln(num(x)))


def log(x: Column | str, base: float) -> Column:
    return F.when(num(x) > 0, F.log10(num(x)) if base == 10 else F.ln(num(x)) / F.ln(F.lit(float(base))))


def cos_degrees(x: Column | str) -> Column:
    """Cosine of degrees, with the rounded pi that the vegetation workflows use (fixed value)."""
    return F.cos(num(x) * F.lit(3.14159265 / 180))


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(num(x), digits)


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within low and high; nodata stays nodata (greatest and least alone would pass over it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def linear_scale(x: Column | str, in_low: float, in_high: float, out_low: float = 0.0, out_high: float = 1.0) -> Column:
    """x clipped to the input range, then mapped to the output range."""
    return (clip(num(x), float(in_low), float(in_high)) - float(in_low)) / (in_high - in_low) * (out_high - out_low) + float(out_low)


def eq_text(a: Column | str, b: Column | str, case_sensitive: bool = True) -> Column:
    return col(a) == col(b) if case_sensitive else F.lower(col(a)) == F.lower(col(b))


def choose(condition: Column, accept: Column, reject: Column | None = None) -> Column:
    """accept where the condition holds, else (a null condition too) reject."""
    picked = F.when(condition, accept)
    return picked if reject is None else picked.otherwise(reject)


def is_valid(x: Column | str) -> Column:
    return col(x).isNotNull()


def array_max(items: Sequence[Column | str], ignore_nodata: bool = True) -> Column:
    """Largest of several columns; with ignore_nodata=False any nodata gives nodata."""
    return _extreme(F.greatest, items, ignore_nodata)


def array_min(items: Sequence[Column | str], ignore_nodata: bool = True) -> Column:
    return _extreme(F.least, items, ignore_nodata)


def _extreme(of, items: Sequence[Column | str], ignore_nodata: bool) -> Column:
    columns = [col(c) for c in items]
    value = of(*columns) if len(columns) > 1 else columns[0]
    if ignore_nodata:
        return value
    valid = columns[0].isNotNull()
    for c in columns[1:]:
        valid = valid & c.isNotNull()
    return F.when(valid, value)


def array_any(items: Sequence[Column | str]) -> Column:
    found = F.lit(False)
    for c in items:
        found = found | F.coalesce(col(c).cast("boolean"), F.lit(False))
    return found


def element(items: Column | str, index: int) -> Column:
    """The element at a 0-based index, nodata beyond the end."""
    return F.get(col(items), F.lit(index))


def text_concat(items: Sequence[Column | str], separator: str = "") -> Column:
    return F.concat_ws(separator, *(col(c).cast("string") for c in items))


def date_shift(date: Column | str, value: int, unit: str) -> Column:
    """A date moved by whole units; the last day of a month stays one where a month is shorter."""
    d = col(date).cast("date")
    months = {"month": 1, "year": 12}
    days = {"day": 1, "week": 7}
    if unit in months:
        return F.add_months(d, value * months[unit])
    if unit in days:
        return F.date_add(d, value * days[unit])
    raise ValueError(f"unknown unit {unit!r}")


def iso_time(epoch: Column | str) -> Column:
    """Seconds as 2024-01-31T12:00:00Z (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_of(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM")


def day_of(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd")


def scenario_id(node: Column | str) -> Column:
    """The part of a test's node id that names its scenario: in the last brackets, else after the last ::, else all."""
    n = col(node)
    bracket = n.contains("[") & n.endswith("]")
    return F.when(bracket, F.regexp_replace(F.substring_index(n, "[", -1), r"\]$", "")).otherwise(F.substring_index(n, "::", -1))


def safe_node_id(node: Column | str) -> Column:
    return F.regexp_replace(col(node), r"[^a-zA-Z0-9_.-]", "_")


def asset_key(run: Column | str, node: Column | str, name: Column | str) -> Column:
    return F.concat_ws("!", col(run), safe_node_id(node), col(name))


def fixed(x: Column | str, digits: int) -> Column:
    """Text with so many decimals, rounded as C's printf does: by the exact binary value, and a tie to the even digit.

    format_string rounds the shortest decimal of the value half up. That differs only where this decimal is a tie (n / steps with n odd) and the value
    isn't above it; its sign against the tie is exact, since both halves of the value times `steps` are (up to 2**53 / steps).
    """
    x, steps = num(x), 2.0 * 10**digits
    v = F.abs(x)
    n = F.rint(v * steps)
    high = v.cast("float").cast("double")
    side = (high * steps - n) + (v - high) * steps
    down = (n % 2 == 1) & (n / steps == v) & ((side < 0) | ((side == 0) & (n % 4 == 1)))
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.when(down, F.signum(x) * (n - 1) / steps).otherwise(x)))


def format_number(x: Column | str) -> Column:
    """Four decimals without trailing zeros; nodata is n/a."""
    text = F.regexp_replace(F.regexp_replace(fixed(x, 4), r"0+$", ""), r"\.$", "")
    return F.when(num(x).isNull() | F.isnan(num(x)), F.lit("n/a")).otherwise(text)


def digitize(x: Column | str, edges: Sequence[float]) -> Column:
    """How many of the ascending edges x has reached; nodata stays nodata."""
    x = num(x)
    value = sum(((x >= e).cast("int") for e in edges), F.lit(0))
    return F.when(x.isNotNull(), value)


def iso_week(t: Column | str) -> Column:
    return F.weekofyear(col(t))


def first_where(items: Column | str, test) -> Column:
    """The first item of an array for which test holds, else nodata."""
    return F.get(F.filter(col(items), test), F.lit(0))


def full_match(text: Column | str, pattern: str) -> Column:
    """Whether the pattern fits the whole text; nodata stays nodata."""
    return col(text).rlike(rf"\A(?:{pattern})\z")


def url_part(url: Column | str, part: str) -> Column:
    """HOST, PATH, QUERY, REF, PROTOCOL, FILE, AUTHORITY or USERINFO of a URL; nodata where it has none or isn't one."""
    return F.try_parse_url(col(url), F.lit(part))


def json_field(text: Column | str, path: str, default: Column | None = None) -> Column:
    """A field of a JSON text, else the default; a field that is null counts as missing."""
    found = F.get_json_object(col(text), path)
    return found if default is None else F.coalesce(found, default)
