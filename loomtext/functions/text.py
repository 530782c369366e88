"""Column functions on text: white space, number formats, match offsets. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Python's ``\s``, written out, since the engines' own classes differ.
WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"\\A[{WS}]+|[{WS}]+\\z", "")


def blank(x: Column) -> Column:
    return ~x.rlike(f"[^{WS}]")


def fixed(x: Column, digits: int) -> Column:
    """Correctly rounded fixed point without grouping: 0.125 is 0.12, 2.675 is 2.67."""
    return F.call_function("format_number", x.cast("double"), F.lit("0" if digits == 0 else "0." + "0" * digits))


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def rounded(x: Column, digits: int) -> Column:
    return fixed(x, digits).cast("double")


def finite(x: Column) -> Column:
    """Null for what JSON has no number for: no number, and both infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def plain(x: Column) -> Column:
    """Shortest text of a double, with an exponent only under -4 or from 16 on."""
    s = x.cast("string")
    mantissa = F.regexp_extract(s, r"^-?(\d+(?:\.\d+)?)E(-?\d+)$", 1)
    exponent = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(
        sign,
        F.when(F.length(digits) - 1 <= exponent, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))).otherwise(
            F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
        ),
    )
    far = F.concat(
        sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    return (
        F.when(~s.contains("E"), s)
        .when((exponent < 0) & (exponent >= -4), small)
        .when((exponent > 0) & (exponent < 16), large)
        .otherwise(far)
    )


def int_list(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(xs.cast("array<string>"), ", "), F.lit("]"))


_MATCHES = "array<struct<text:string,start:int,end:int>>"
#: Matches are gathered in parts of this length, so that appending does not copy all of them each time.
_PART = 256


def find_all(x: Column, pattern: str) -> Column:
    """Array of (text, start, end) of the matches: no engine gives offsets, but the lengths of the
    gaps between matches and of the matches add up to them."""
    found, gaps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    none = F.array().cast(_MATCHES)

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        part = F.array_append(a["part"], F.struct(p["m"].alias("text"), start.alias("start"), end.alias("end")))
        full = F.size(a["part"]) + 1 >= _PART
        return F.struct(
            end.alias("at"), F.when(full, none).otherwise(part).alias("part"), F.when(full, F.array_append(a["parts"], part)).otherwise(a["parts"]).alias("parts")
        )

    out = F.aggregate(
        F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        F.struct(F.lit(0).alias("at"), none.alias("part"), F.array().cast(f"array<{_MATCHES}>").alias("parts")),
        step,
        lambda a: F.flatten(F.array_append(a["parts"], a["part"])),
    )
    return F.when(x.rlike(pattern), out).otherwise(none)


def cut(x: Column, start: Column, end: Column) -> Column:
    """Code points from start up to end, both held within the text."""
    a = F.greatest(start, F.lit(0))
    return F.substr(x, a + 1, F.greatest(F.lit(0), F.least(end, F.length(x)) - a))


def blanked(x: Column, pattern: str) -> Column:
    """Each match replaced by as many spaces; line feeds stay."""
    found, gaps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    spaces = F.transform(found, lambda m: F.regexp_replace(m, "[^\n]", " "))
    joined = F.concat_ws(
        "", F.zip_with(gaps, spaces, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    )
    return F.when(x.rlike(pattern), joined).otherwise(x)


def pstdev(xs: Column) -> Column:
    """Population standard deviation of an array of integers, with one rounding before the root."""
    n = F.size(xs).cast("bigint")
    s1 = F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, v: a + v)
    s2 = F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v)
    return F.sqrt((n * s2 - s1 * s1).cast("double")) / n


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("double") / F.size(xs)


def sanitized(x: Column) -> Column:
    """For terminals: control characters as \\xNN, bidirectional and line separators as \\u{NNNN}."""
    for c in [*range(0x20), *range(0x7F, 0xA0)]:
        if c not in (9, 10):
            x = F.replace(x, F.lit(chr(c)), F.lit(f"\\x{c:02x}"))
    for c in (0x061C, 0x200E, 0x200F, *range(0x2028, 0x202F), *range(0x2066, 0x206A)):
        x = F.replace(x, F.lit(chr(c)), F.lit(f"\\u{{{c:04x}}}"))
    return x
