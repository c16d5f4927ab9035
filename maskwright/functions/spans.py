"""Spans: places in a text as an array column, found by patterns and resolved where they overlap.

Offsets are code points. Spark has no function for the places of all matches, but the same pattern cuts the text into stretches
that end with a match, and their lengths add up to the places; matches that a look-around rejects are never counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string,source:string,ord:int,entity_id:string,token:string,render:string,level:int>"
SPANS = f"array<{SPAN}>"
#: Whose span wins where two overlap, lowest first.
SOURCE_RANK = {"rule": 0, "gold": 0, "glossary": 1, "llm": 2}


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, kind: Column, source: Column, ord_: Column, entity_id: Column | None = None, token: Column | None = None, render: Column | None = None, level: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"), source.alias("source"), ord_.cast("int").alias("ord"), (entity_id if entity_id is not None else null).cast("string").alias("entity_id"),
        (token if token is not None else null).cast("string").alias("token"), (render if render is not None else null).cast("string").alias("render"), (level if level is not None else null).cast("int").alias("level"),
    )


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), make)[0]


def places(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start,end,surface>> of all matches (of a pattern that matches no empty string), left to right; with ``group`` = 1,
    of the group that ends the match.

    The text is evaluated once and read twice, whatever the number of matches: for the matches, and for the stretches from the
    end of one to the end of the next, whose lengths add up to the places; an only match, whose string the text holds nowhere
    else, is where that string is. Spark keeps a pattern that it extracts by, but
    compiles one that it splits by anew for each text, and evaluates again whatever a lambda does not get by a variable.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    upto = F.lit(rf"\G[\s\S]*?(?:{pattern})") if isinstance(pattern, str) else F.concat(F.lit(r"\G[\s\S]*?(?:"), pattern, F.lit(")"))
    empty = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def placed(found: Column, stretches: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            stop, one = acc["at"] + F.length(F.element_at(stretches, k)), F.element_at(found, k)
            place = F.struct((stop - F.length(one)).cast("int").alias("start"), stop.cast("int").alias("end"), one.alias("surface"))
            return F.struct(stop.cast("int").alias("at"), F.array_append(acc["out"], place).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(found)), state, step, lambda acc: acc["out"])

    def of(t: Column) -> Column:
        def all_of(found: Column) -> Column:
            general = let(F.regexp_extract_all(t, upto, F.lit(0)), lambda stretches: placed(found, stretches))

            def only(one: Column, at: Column) -> Column:
                place = F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(one)).cast("int").alias("end"), one.alias("surface"))
                return F.when((F.size(found) == 1) & (F.position(one, t, at + 1) == 0), F.array(place)).otherwise(general)

            located = let(F.element_at(found, 1), lambda one: let(F.position(one, t), lambda at: only(one, at)))
            return F.when(F.size(found) > 0, located).otherwise(empty)

        return let(F.regexp_extract_all(t, regex, F.lit(group)), all_of)

    return let(text, of)


def _rank(x: Column) -> Column:
    out = F.lit(9)
    for name, rank in SOURCE_RANK.items():
        out = F.when(x["source"] == name, F.lit(rank)).otherwise(out)
    return out


def _sorted(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Spans by ``keys``, equal ones in the order in which they came: each key is evaluated once for a span."""
    keyed = F.sort_array(F.transform(spans, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), x.alias("x"))))
    return F.transform(keyed, lambda e: e["x"])


def by_place(spans: Column) -> Column:
    return _sorted(spans, lambda x: x["start"], lambda x: x["ord"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """Disjoint spans by place: by source, then length, then place, each span is kept if it overlaps none kept before."""
    ranked = _sorted(spans, _rank, lambda x: x["start"] - x["end"], lambda x: x["start"], lambda x: x["ord"])
    kept = F.aggregate(ranked, no_spans(), lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.array_append(acc, x)))
    return by_place(kept)


def surface(text: Column, x: Column) -> Column:
    return F.substr(text, x["start"] + 1, x["end"] - x["start"])
