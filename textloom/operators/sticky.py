"""Merging of stray single characters and negations with their neighbours, by part-of-speech weights: one fold over the tokens of a text, in Spark's own array functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How loosely a word of a flag stands by itself, flags without an entry have 1 (fixed values).
LOOSE = {"a": 5.2, "n": 3.5, "vn": 3.5, "ns": 3.5, "nt": 3.5, "nz": 3.5, "an": 3.5, "d": 6.5, "v": 6.5, "x": 0.0, "q": 2.0, "uj": 4.0, "ul": 4.0, "m": 3.0, "r": 6.0}
#: Flags that never stick: every substring of this (fixed value).
FREE = "ujulxepcykzgqrmd"
#: Words that stick to what follows (fixed values).
NEGATIONS = ("不", "没", "无")
#: Characters that never stick (fixed values); the pipeline has two more.
STOP = "是也着很到就刚才蛮都让太去来找上下卖说有叫起要"
#: What a text's last token has for a neighbour (fixed values).
END = ("。", "x")


@dataclass(frozen=True)
class Rules:
    """stop: characters that never stick. wanted: a kept word's flag shares a character with it and its length is over `longer`; empty: any flag with a character other than x."""

    stop: str = ""
    wanted: str = ""
    longer: int = 0
    unwanted: str = ""


WORDS = Rules(STOP, "anvd", 1, "eng")
PIPELINE = Rules(STOP + "使令")

_PAIR = "struct<word:string,flag:string>"


def loose(flag: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LOOSE.items() for x in pair))
    return F.coalesce(F.try_element_at(table, flag), F.lit(1.0))


def tight(flag: Column) -> Column:
    return F.when(loose(flag).isin(0.0, 1.0), loose(flag)).otherwise(10.0 - loose(flag))


def _glued(a: Column, b: Column) -> Column:
    return F.struct(F.concat(a["word"], b["word"]).alias("word"), F.concat(a["flag"], b["flag"]).alias("flag"))


def _facts(t: Column, rules: Rules) -> Column:
    """What the fold needs to know of a token between its neighbours: both pulls, and which rule is for it."""
    here, before, after = t["here"], t["before"], t["after"]
    halves = lambda x: F.ceil(F.length(x["word"]) / 2)
    negation = here["word"].isin(*NEGATIONS)
    stray = (F.length(here["word"]) == 1) & ~negation & ~F.lit(rules.stop).contains(here["word"]) & ~F.lit(FREE).contains(here["flag"])
    return F.struct(
        here.alias("here"), before.alias("before"), after.alias("after"),
        (F.pow(loose(before["flag"]), F.lit(2)) * tight(here["flag"]) / halves(before)).alias("back"),
        (F.pow(loose(here["flag"]), F.lit(2)) * tight(after["flag"]) / halves(after)).alias("ahead"),
        F.coalesce(stray, F.lit(False)).alias("stray"), F.coalesce(negation & (after["flag"] != "x"), F.lit(False)).alias("negates"),
    )


def merged(pairs: Column, rules: Rules) -> Column:
    """array<struct<word,flag>> in which stray characters and negations are glued to a neighbour. pairs: a plain column, as it is read several times; null stays null.

    A stray character goes to the side that pulls harder, the earlier one if both pull alike; side and character of one flag stay apart. What went ahead weakens the next token's pull backwards, and a longer word that was glued on is not looked at again.
    The last word of the result is kept apart in the fold's state, because a character that goes back replaces it by its own neighbour and itself.
    """
    n = F.size(pairs)
    end = F.array(F.struct(F.lit(END[0]).alias("word"), F.lit(END[1]).alias("flag")))
    around = F.arrays_zip(pairs.alias("here"), F.concat(end, F.slice(pairs, 1, F.greatest(n - 1, F.lit(0)))).alias("before"), F.concat(F.slice(pairs, 2, F.greatest(n - 1, F.lit(0))), end).alias("after"))
    tokens = F.transform(around, lambda t: _facts(t, rules))
    start = F.struct(F.lit(0).alias("skip"), F.lit(1.0).alias("damp"), F.array().cast(f"array<{_PAIR}>").alias("done"), F.lit(None).cast(_PAIR).alias("last"))

    def step(s: Column, t: Column) -> Column:
        begun = s["last"].isNotNull()
        back, ahead = t["back"] * s["damp"], t["ahead"]
        goes_back = begun & t["stray"] & (back >= ahead) & (back > 0)
        goes_ahead = begun & ((t["stray"] & (back < ahead) & (ahead > 0)) | t["negates"])
        replaces = goes_back & (t["before"]["flag"] != t["here"]["flag"])
        takes = goes_ahead & (t["negates"] | (t["here"]["flag"] != t["after"]["flag"]))
        word = F.when(replaces, _glued(t["before"], t["here"])).when(takes, _glued(t["here"], t["after"])).otherwise(t["here"])
        passed = s["skip"] > 0
        return F.struct(
            F.when(passed, s["skip"] - 1).when(takes & (F.length(t["after"]["word"]) > 1), 1).otherwise(0).alias("skip"),
            F.when(passed, s["damp"]).when(goes_ahead, 0.2).otherwise(1.0).alias("damp"),
            F.when(passed | replaces | ~begun, s["done"]).otherwise(F.array_append(s["done"], s["last"])).alias("done"),
            F.when(passed, s["last"]).otherwise(word).alias("last"),
        )

    return F.aggregate(tokens, start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["last"])))


def kept(pairs: Column, rules: Rules) -> Column:
    if not rules.wanted:
        return F.filter(pairs, lambda t: t["flag"].rlike("[^x]"))
    return F.filter(pairs, lambda t: (F.length(t["word"]) > rules.longer) & t["flag"].rlike(f"[{rules.wanted}]") & (t["flag"] != rules.unwanted))


def sticky(pairs: Column, rules: Rules = PIPELINE) -> Column:
    """array<struct<word,flag>> merged and filtered; null gives an empty array. pairs: a plain column."""
    return F.coalesce(kept(merged(pairs, rules), rules), F.array().cast(f"array<{_PAIR}>"))
