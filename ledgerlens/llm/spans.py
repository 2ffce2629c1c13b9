"""Positions of regular-expression matches, with built-in functions only.

Arrays are worked through in blocks of about the square root of their length:
appending to an array copies it, so one pass over a whole array would cost the
square of its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,rank:int,start:int,end:int,text:string,before:string,after:string,part:string>"


def no_spans() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


LEAST_BLOCK = 256


def in_blocks(items: Column) -> Column:
    """The array cut into arrays of 256 entries, or of the root of its length."""
    n = F.size(items)
    width = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(n)).cast("int"))
    last = F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * width + 1, width))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def find_spans(text: Column, kind: str, rank: int, regex: str, group: int = 0,
               context: int = 0, guard: Column | None = None) -> Column:
    """Array of the leftmost non-overlapping matches of ``regex`` in ``text``.

    Offsets are code points, end exclusive: the pieces between the matches
    (``split``) and the matches themselves alternate, so a running sum of
    their lengths, within a block and then over blocks, gives every start.  ``part`` is the text of ``group``;
    ``before`` and ``after`` hold up to ``context`` characters of the
    neighbouring pieces.  The search runs only where ``guard`` and a plain
    ``rlike`` hold.
    """
    hit = text.rlike(regex) if guard is None else guard & text.rlike(regex)
    m = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    g = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else m
    def one(acc, z):
        start = acc["pos"] + F.length(z["p"])
        end = start + F.length(z["m"])
        span = F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"),
            z["m"].alias("text"),
            (F.right(z["p"], F.lit(context)) if context else F.lit("")).alias("before"),
            (F.substring(z["after"], 1, context) if context else F.lit("")).alias("after"),
            z["g"].alias("part"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    p = F.split(text, regex, -1)                  # one piece more than matches
    shifted = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))) if context else p
    zipped = F.arrays_zip(m.alias("m"), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))).alias("p"),
                          g.alias("g"), shifted.alias("after"))
    zipped = F.filter(zipped, lambda z: z["m"].isNotNull())
    def block(z: Column) -> Column:
        return F.aggregate(z, F.struct(F.lit(0).alias("pos"), no_spans().alias("out")), one)

    def placed(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at"))
        starts = F.aggregate(blocks, first, lambda acc, b: F.struct(
            (acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["at"], F.array(acc["pos"])).alias("at")))["at"]

        def moved(s: Column, at: Column) -> Column:
            return F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"),
                            s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after"), s["part"].alias("part"))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["out"], lambda s: moved(s, at))))
    found = let(zipped, lambda z: let(F.transform(in_blocks(z), block), placed))
    return F.when(hit, found).otherwise(no_spans())


def listed(spans: Column, order: list[str]) -> Column:
    """``kind:start:end`` of the spans sorted by ``order``, comma-joined."""
    keys = F.transform(spans, lambda s: F.struct(
        *[s[c] for c in order], F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("said")))
    return F.array_join(F.transform(F.sort_array(keys), lambda s: s["said"]), ",")
