"""Text columns: tokens, clean-up, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digit runs, ASCII-letter runs, single CJK characters; everything else separates.
MIXED = "[0-9]+|[a-zA-Z]+|[一-龥]"
#: Digit runs and runs of letters of any script.
LETTERS = r"[0-9]+|\p{L}+"
#: As LETTERS, and every other visible character as a token of its own.
MARKS = r"[0-9]+|\p{L}+|[^\s0-9\p{L}]"
#: Phrases deleted and phrases rewritten before segmentation (fixed values, in this order).
DELETED = ["为什么", "什么", "怎么"]
REWRITTEN = [("不太", "不"), ("不是", "不")]


def tokens(text: Column, pattern: str = MIXED) -> Column:
    """All matches of the pattern, in order."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def cleaned(text: Column) -> Column:
    """Text without the deleted phrases and with the rewritten ones."""
    for phrase in DELETED:
        text = F.regexp_replace(text, phrase, "")
    for old, new in REWRITTEN:
        text = F.regexp_replace(text, old, new)
    return text


def kept_flags(pairs: Column) -> Column:
    """Of (word, flag) structs those whose flag has a character other than x."""
    return F.filter(pairs, lambda t: t["flag"].rlike("[^x]"))


def real_term(term: Column) -> Column:
    """Terms of more than one character with a CJK or Latin letter."""
    return (F.length(term) > 1) & term.rlike("[一-龥a-zA-Z]")


def roundup(x: Column, digits: int) -> Column:
    """x rounded up to so many decimals."""
    return F.ceil(x * float(10**digits)) / float(10**digits)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals as SQL rounds doubles: scaled, halves away from zero, scaled back. F.round goes by the shortest decimal text of x instead, which can be a half where x is below it."""
    return F.round(x * float(10**digits), 0) / float(10**digits)
