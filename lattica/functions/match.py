"""Predicates that compare names and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import period_end, period_start


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def word_runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; shorter texts are one run."""
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, n))))


def squeezed(c: Column) -> Column:
    """Lower case, without white space and the signs - _ , . / ( )."""
    return F.lower(F.regexp_replace(c, r"[\s\-_,./()]", ""))


def contains_either(a: Column, b: Column) -> Column:
    """Equal, or one within the other, once squeezed; blank matches nothing."""
    x, y = squeezed(a), squeezed(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """Inclusive; a null bound is open."""
    return F.coalesce(start <= day, F.lit(True)) & F.coalesce(day <= end, F.lit(True))


def period_contains(period: Column, day: Column) -> Column:
    """Whether ``start ~ end`` holds a day; false unless both ends are dates."""
    return F.coalesce(day.between(period_start(period), period_end(period)), F.lit(False))


# Words of a status that ends a registration.
INACTIVE = ("말소", "폐업", "취소", "정지", "만료", "유효기간경과")


def active_status(status: Column, inactive: tuple[str, ...] = INACTIVE) -> Column:
    """Whether a status names none of these words; a null status is active."""
    return ~F.coalesce(squeezed(status).rlike("|".join(inactive)), F.lit(False))


def changed(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def ordered_fragments(text: Column, cited: Column, ellipsis: str = r"\.\.\.|…") -> Column:
    """Whether the parts of a citation around its ellipses occur in the text, in order."""
    parts = F.filter(F.transform(F.split(cited, ellipsis), lambda p: F.trim(p)), lambda p: p != "")

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(part)).otherwise(F.lit(0))

    return (F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0)
