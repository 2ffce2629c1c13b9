"""Interaction audit of document filters (operator 13).

Which filter removes a document depends on the order in which filters run.
This audit gives, for every part of a corpus, every order of the filters and
every step of an order, what is kept and removed there, without running any
order: documents are counted once by the set of filters they fail (a mask),
and all orders are read off those counts.

Method: the orders of five letters, sorted, have the Lehmer ranks 0 to 119.
The orders that begin with the same ``s`` letters are neighbours: they fill an
interval of (5 - s)! ranks.  A document with mask ``m`` is removed at step
``s`` by exactly the orders whose first ``s - 1`` letters are outside ``m``
and whose letter ``s`` is inside, so each (mask, such beginning) gives one
interval.  Its counts are added where the interval begins and taken off where
it ends, and a running sum over the 120 ranks gives the removals of every
order.

The duplicate filter needs no window over a group of copies: the least id of
every text is found by a pre-aggregated minimum, and joined on (text, id), so
that the copies of one text spread over all tasks.

Defined results: null text counts as empty, null part as the empty string;
texts are compared by SHA-256; a row without id is never a later copy, and no
copy of anything; rows that repeat an id and text are copies of neither; an
id with several label rows has a label if any of them has it, labels of null
ids belong to nothing; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_table

LETTERS = "ABCDE"
ORDERS = factorial(len(LETTERS))
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("docs", "good", "toxic")


# --- ranks -----------------------------------------------------------------

def first_rank(beginning: str) -> int:
    """Lehmer rank of the first order that starts with these letters."""
    left, rank = list(LETTERS), 0
    for c in beginning:
        at = left.index(c)
        left.pop(at)
        rank += at * factorial(len(left))
    return rank


def order_of(rank: int) -> str:
    """The order with a Lehmer rank."""
    left, out = list(LETTERS), ""
    while left:
        at, rank = divmod(rank, factorial(len(left) - 1))
        out += left.pop(at)
    return out


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def interval_ends() -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): +1 where the orders that remove the mask at
    the step begin, -1 behind them."""
    ends = []
    for step in range(1, len(LETTERS) + 1):
        width = factorial(len(LETTERS) - step)
        for beginning in permutations(LETTERS, step):
            passed, hit = sum(map(bit, beginning[:-1])), bit(beginning[-1])
            at = first_rank("".join(beginning))
            for mask in range(1 << len(LETTERS)):
                if mask & hit and not mask & passed:
                    ends += [(mask, step, at, 1), (mask, step, at + width, -1)]
    return ends


# --- documents -------------------------------------------------------------

def failed(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n, chars = F.size(words).cast("long"), F.length(text).cast("long")
    fails = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * chars,
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(c, F.lit(bit(k))).otherwise(0) for k, c in fails.items()), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, docs): documents counted by the filters they
    fail and their labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), failed(text).alias("mask"))
    each = shared_table(each, "filter-marks")
    first = each.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id"))
    # copies differ in their id: (same, id) holds repeated rows only, counted before the join
    known = each.where("id IS NOT NULL").groupBy("same", "id", "part", "mask").agg(F.count("*").alias("docs"))
    known = known.join(first.withColumn("first", F.lit(True)), ["same", "id"], "left")
    known = (known.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(bit("E")))
             .groupBy("id", "part", "mask").agg(F.sum("docs").alias("docs")))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    nameless = (each.where("id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("docs"))
                .select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "docs"))
    return (known.join(marks, "id", "left")
            .select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "docs")
            .unionByName(nameless)
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("docs").alias("docs")))


# --- orders ----------------------------------------------------------------

def removals(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """(part, rank, step, docs, good, toxic) removed by every order at every
    step, from counts by (part, mask)."""
    ends = spark.createDataFrame(interval_ends(), "mask int, step int, rank int, sign int")
    steps = spark.range(ORDERS).selectExpr("CAST(id AS int) AS rank", f"explode(sequence(1, {len(LETTERS)})) AS step")
    changes = (counted.join(F.broadcast(ends), "mask").where(F.col("rank") < ORDERS)
               .select("part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(c) for c in COUNTS]))
    still = (counted.select("part").distinct().join(F.broadcast(steps))      # every rank of every step, changed or not
             .select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in COUNTS]))
    at = changes.unionByName(still).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    upto = Window.partitionBy("part", "step").orderBy("rank")
    return at.select("part", "rank", "step", *[F.sum(c).over(upto).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    spark = docs.sparkSession
    by_label = shared_table(marked(docs, labels), "filter-counts")           # at most 128 rows a part
    counted = by_label.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("good") * F.col("docs")).alias("good"),
        F.sum(F.col("toxic") * F.col("docs")).alias("toxic"))
    totals = counted.groupBy("part").agg(
        F.sum("docs").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(bit(c)) != 0, F.col("docs")).otherwise(0)).alias(f"fails_{c}") for c in LETTERS],
        *[F.sum(F.when(F.col("mask") == bit(c), F.col("docs")).otherwise(0)).alias(f"unique_{c}") for c in LETTERS])
    orders = spark.createDataFrame([(r, order_of(r)) for r in range(ORDERS)], "rank int, filter_order string")
    each = (removals(spark, counted).join(F.broadcast(orders), "rank")
            .withColumn("letter", F.expr("substring(filter_order, step, 1)")))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    of_filter = Window.partitionBy("part", "letter")
    each = each.withColumns({"gone": F.sum("docs").over(so_far), "shapley": F.sum("docs").over(of_filter)})

    def own(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("letter") == c, F.col(f"{name}_{c}")) for c in LETTERS])
    return each.join(totals, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("docs").alias("removed"),
        (own("fails") - F.col("docs")).alias("redundant"), own("unique").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
