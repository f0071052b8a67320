"""All matches of a pattern with their positions, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    """Spell out word edges: Java's ``\\b`` also counts accented letters as word characters."""
    return pattern.replace(r"\b", WORD_EDGE)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def spans(text: Column, pattern: str, groups: int = 1) -> Column:
    """array<struct<start, stop, m0, m1, ...>> of the non-overlapping matches, in order.

    Matches come from ``regexp_extract_all``, the gaps between them from
    ``split``; running lengths of both give the positions.
    """
    names = [f"m{n}" for n in range(groups + 1)]
    kind = "array<struct<start:int,stop:int," + ",".join(f"{n}:string" for n in names) + ">>"

    def placed(read: Column) -> Column:
        def grow(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.length(F.get(read["gaps"], i))
            stop = at + F.length(F.get(read["m0"], i))
            row = F.struct(at.alias("start"), stop.alias("stop"), *[F.get(read[n], i).alias(n) for n in names])
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).cast(kind).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(read["m0"]) - 1), zero, grow, lambda acc: acc["out"])

    read = F.struct(F.split(text, pattern, -1).alias("gaps"), *[
        F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names)])
    # a text without a match is read once
    return F.when(text.rlike(pattern), let(read, placed)).otherwise(F.array().cast(kind))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])
