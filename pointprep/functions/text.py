"""Scalar text functions as column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a CSV scan takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def remove_spaces(c: Column) -> Column:
    """Blanks (U+0020) out; tabs and other white space stay."""
    return F.replace(c, F.lit(" "), F.lit(""))


def strip(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def dedup_key(c: Column) -> Column:
    """Lower case without outer white space; separators stay."""
    return F.lower(strip(c))


def normalize(c: Column) -> Column:
    """Lower case; runs of hyphens, underscores, colons and white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[-_:\s]+", " "))


def camel_split(c: Column) -> Column:
    """A blank between a small and a capital ASCII letter, then lower case."""
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def strip_suffix(c: Column, suffix: str = ":present-value") -> Column:
    """``suffix`` off the end, once, in any case."""
    return F.regexp_replace(c, rf"(?i)\Q{suffix}\E$", "")


def tokens(c: Column) -> Column:
    """Words between blanks; no words for the empty string."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def na_to_null(c: Column, na_tokens: list[str] | None = None) -> Column:
    return F.when(~c.isin(NA_TOKENS if na_tokens is None else na_tokens), c)


def contains_any(c: Column, keywords: list[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(c, F.lit(k))
    return found


def percent(part: Column, whole: Column) -> Column:
    """``12.3%``; null for nothing of nothing. Rounds the binary value of the quotient, halves to even, and not its shortest decimal form: 12.35 is a little less and gives 12.3."""
    x = 100.0 * part / whole
    units = F.floor(x)
    # Ten times the fraction in units of 2**-60, which hold all its bits.
    scaled = F.floor((x - units) * float(1 << 60)).cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    one = F.lit(1 << 60).cast("decimal(20,0)")
    tenth = F.floor(scaled / one)
    rest = scaled - tenth * one
    half = F.lit(1 << 59).cast("decimal(20,0)")
    up = ((rest > half) | ((rest == half) & (tenth % 2 == 1))).cast("int")
    tenths = units * 10 + tenth.cast("long") + up
    return F.when(whole > 0, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def argmax(logits: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax_max(logits: Column) -> Column:
    """Largest softmax probability."""
    top = F.array_max(logits)
    return 1.0 / F.aggregate(logits, F.lit(0.0).cast("double"), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
