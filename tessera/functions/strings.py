"""String columns. Nulls pass through transforms; tests on null are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lower, upper, strip, lstrip, rstrip = F.lower, F.upper, F.trim, F.ltrim, F.rtrim


def _test(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def title(s: Column) -> Column:
    """First letter of each word upper, the rest untouched."""
    return F.array_join(F.transform(F.split(s, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def replace(s: Column, old: str, new: str, n: int = -1) -> Column:
    """Literal replacement of the first ``n`` occurrences, all if negative."""
    if n < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, _quoted(old), n + 1)
    return F.array_join(parts, new)


def _quoted(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _bound(s: Column, at: int) -> Column:
    return F.greatest(F.lit(0), F.length(s) + at) if at < 0 else F.least(F.length(s), F.lit(at))


def slice_(s: Column, start: int, end: int) -> Column:
    """Characters [start, end); negative bounds count from the end of each row's string."""
    a, b = _bound(s, start), _bound(s, end)
    return F.when(b > a, F.substring(s, a + 1, b - a)).otherwise(F.when(s.isNotNull(), F.lit("")))


def slice_replace(s: Column, start: int, end: int, new: str) -> Column:
    a, b = _bound(s, start), F.greatest(_bound(s, start), _bound(s, end))
    return F.concat(F.substring(s, F.lit(1), a), F.lit(new), F.substring(s, b + 1, F.length(s)))


def pad(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Pad to ``width`` without ever truncating; 'both' puts the extra character on the right."""
    to = F.greatest(F.lit(width), F.length(s))
    if side == "left":
        return F.lpad(s, to, F.lit(fill))
    if side == "right":
        return F.rpad(s, to, F.lit(fill))
    left = F.length(s) + F.floor((to - F.length(s)) / 2).cast("int")
    return F.rpad(F.lpad(s, left, F.lit(fill)), to, F.lit(fill))


def ljust(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "right", fill)


def rjust(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "left", fill)


def center(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "both", fill)


def zfill(s: Column, width: int) -> Column:
    return pad(s, width, "left", "0")


def contains(s: Column, what: str, regex: bool = False) -> Column:
    return _test(s.rlike(what) if regex else F.contains(s, F.lit(what)))


def startswith(s: Column, what: str) -> Column:
    return _test(F.startswith(s, F.lit(what)))


def endswith(s: Column, what: str) -> Column:
    return _test(F.endswith(s, F.lit(what)))


def isalpha(s: Column) -> Column:
    return _test(s.rlike(r"^\p{L}+$"))


def isdigit(s: Column) -> Column:
    return _test(s.rlike(r"^\p{Nd}+$"))


def isalnum(s: Column) -> Column:
    return _test(s.rlike(r"^[\p{L}\p{Nd}]+$"))


def isspace(s: Column) -> Column:
    return _test(s.rlike(r"^\p{IsWhite_Space}+$"))


def islower(s: Column) -> Column:
    return _test(s.rlike(r"\p{L}") & ~s.rlike(r"[\p{Lu}\p{Lt}]"))


def isupper(s: Column) -> Column:
    return _test(s.rlike(r"\p{L}") & ~s.rlike(r"\p{Ll}"))


def len_(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def count(s: Column, what: str) -> Column:
    """Non-overlapping occurrences; an empty needle is found between all characters."""
    if not what:
        return F.coalesce(F.length(s) + 1, F.lit(0))
    return F.coalesce(F.size(F.split(s, _quoted(what), -1)) - 1, F.lit(0))


def find(s: Column, what: str) -> Column:
    """0-based position or -1."""
    return F.coalesce(F.instr(s, what) - 1, F.lit(-1))


def split(s: Column, sep: str, n: int = -1) -> Column:
    """Literal separator; at most ``n`` parts, all if negative, null for 0."""
    return F.lit(None).cast("array<string>") if n == 0 else F.split(s, _quoted(sep), n)


def extract(s: Column, pattern: str, groups: int) -> Column:
    """Capture groups of the first match; null without one."""
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, i) for i in range(1, groups + 1)]))


def to_numeric(s: Column) -> Column:
    """double; NaN where the text is no number."""
    return F.coalesce(s.try_cast("double"), F.when(s.isNotNull(), F.lit(float("nan"))))
