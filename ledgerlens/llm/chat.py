"""Chat formatting with a loss mask (operator 11).

A conversation becomes one text of turns in a fixed template::

    <|im_start|>role
    text<|im_end|>

Adjacent turns of one role share a header and are set apart by ``<|turn|>``, so
that the turns can be told apart again.  The loss mask lists the code-point
spans of the assistant texts, and nothing else.

Control strings inside texts are escaped: ``<``, any number of backslashes and
``|`` get one backslash more, so no ``<|`` is left in a text, and taking one
backslash off gives the text back.  In roles ``%`` and line feeds are also
written as ``%25`` and ``%0A``.

Method: relational formatting with Spark expressions only.  Turns are collected
as structs and sorted, an array aggregation merges adjacent turns of a role,
and expressions concatenate what results.

A conversation of up to ``TURNS`` turns is one piece.  A longer one is dealt by
ranges of its turns, so that no task gets all of it, and becomes several pieces
in order, whose concatenation is the conversation: a run of one role that
crosses pieces is neither closed nor opened again there.  Only the digest of
such a conversation needs its pieces one after the other; it is taken as a
stream (a hash has to see all bytes in order), piece by piece.

Defined results: null texts and roles count as empty; the turns of a
conversation are ordered by turn (null first), then role, the first 64
characters of the text, a hash of the text, the text; repeated rows are turns
of their own; the rows of a null id are one conversation; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_table, workers_ready

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
TOKEN = r"<\|im_start\|>[^\n]*\n|<\|turn\|>|<\|im_end\|>\n"
LEARNED = "assistant"
TURNS = 128                     # turns of a piece at most
BROADCAST_IDS = 2_000_000       # ids of long conversations broadcast at most


# --- escapes ---------------------------------------------------------------

def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


# --- formatting ------------------------------------------------------------

RUN = "struct<role:string,texts:array<string>>"
SPAN = "struct<start:bigint,end:bigint>"


def merged(turns: Column) -> Column:
    """Runs of adjacent turns of a role, from the sorted turns of a piece."""
    def add(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        alone = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        longer = F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        return (F.when(F.size(runs) == 0, F.array(alone))
                .when(last["role"] == t["role"], F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer)))
                .otherwise(F.concat(runs, F.array(alone))))
    return F.aggregate(turns, F.expr(f"CAST(array() AS array<{RUN}>)"), add)


def segments(runs: Column, carried_in: Column, carried_out: Column) -> Column:
    """(text, learned) segments of a piece; a run that the piece before or
    behind holds too stays open at that end."""
    def of_run(r: Column, i: Column) -> Column:
        opened = F.when((i == 0) & carried_in, F.lit(TURN)).otherwise(
            F.concat(F.lit(START), escaped_role(r["role"]), F.lit("\n")))
        closed = F.when((i == F.size(runs) - 1) & carried_out, F.lit("")).otherwise(F.lit(END))
        texts = F.flatten(F.transform(r["texts"], lambda t, j: F.array(
            F.struct(F.when(j == 0, opened).otherwise(F.lit(TURN)).alias("text"), F.lit(False).alias("learned")),
            F.struct(escaped(t).alias("text"), (r["role"] == LEARNED).alias("learned")))))
        return F.concat(texts, F.array(F.struct(closed.alias("text"), F.lit(False).alias("learned"))))
    return F.flatten(F.transform(runs, of_run))


def spans_of(parts: Column) -> Column:
    """Code-point spans of the learned segments."""
    def add(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"),
                        F.when(s["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"),
                                       F.expr(f"CAST(array() AS array<{SPAN}>)").alias("spans")), add)["spans"]


def _rendered(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces with sorted ``turns`` of structs (order..., role, text, before,
    after), formatted."""
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    return (pieces
            .withColumn("carried_in", F.coalesce(first["before"] == first["role"], F.lit(False)))
            .withColumn("carried_out", F.coalesce(last["after"] == last["role"], F.lit(False)))
            .withColumn("runs", merged(F.col("turns")))
            .withColumn("parts", segments(F.col("runs"), F.col("carried_in"), F.col("carried_out")))
            .select(*keys, F.array_join(F.transform("parts", lambda s: s["text"]), "").alias("formatted"),
                    spans_of(F.col("parts")).alias("loss_spans")))


def _rows(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.substring(text, 1, 64).alias("head"), F.xxhash64(text).alias("h"), text.alias("text"))


ORDER = ("turn", "role", "head", "h", "text")


def _long_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of long conversations, cut from ranges of their turns."""
    spark = rows.sparkSession
    n = partitions(spark)
    # rows equal in all else may stand anywhere among themselves: the last key spreads them
    dealt = rows.withColumn("_r", F.rand(7)).repartitionByRange(n, "conv_id", "turn", "role", "head", "h", "_r")
    dealt = shared_table(dealt.drop("_r").withColumn("part", F.spark_partition_id()), "chat-long")
    # what a conversation's next range begins with and its last one ended with: two rows a range boundary at most
    key = F.struct(*ORDER[:4])
    ends = dealt.groupBy("conv_id", "part").agg(F.min_by("role", key).alias("first_role"), F.max_by("role", key).alias("last_role"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    ends = (ends.withColumns({"came": F.lag("last_role").over(by_part), "comes": F.lead("first_role").over(by_part)})
            .where("came IS NOT NULL OR comes IS NOT NULL").select("conv_id", "part", "came", "comes"))
    within = Window.partitionBy("part", "conv_id").orderBy(*ORDER)
    placed = dealt.withColumns({"_n": F.row_number().over(within), "before": F.lag("role").over(within),
                                "after": F.lead("role").over(within)})
    e = F.broadcast(ends.withColumnsRenamed({"conv_id": "_c", "part": "_p"}))
    placed = (placed.join(e, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
              .withColumns({"before": F.coalesce("before", "came"), "after": F.coalesce("after", "comes")}))
    piece = F.col("part").cast("long") * (1 << 40) + ((F.col("_n") - 1) / TURNS).cast("long")
    return (placed.withColumn("piece", piece).groupBy("part", "conv_id", "piece")
            .agg(F.sort_array(F.collect_list(F.struct(*ORDER, "before", "after"))).alias("turns")))   # at most TURNS


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, long, formatted, loss_spans): the conversations' pieces,
    with the code-point spans of the learned texts in each piece."""
    rows = _rows(conversations)
    long_ids = shared_table(rows.groupBy("conv_id").count().where(F.col("count") > TURNS)
                            .select(F.col("conv_id").alias("_c")), "chat-ids")
    n = long_ids.count()
    none = F.lit(None).cast("string")
    if n == 0:
        short = rows
    else:
        ids = F.broadcast(long_ids) if n <= BROADCAST_IDS else long_ids
        same = F.col("conv_id").eqNullSafe(F.col("_c"))
        short = rows.join(ids, same, "left_anti")
    short = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(                                # at most TURNS
        F.struct(*ORDER, none.alias("before"), none.alias("after")))).alias("turns"))
    short = short.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(False).alias("long"), "turns")
    out = _rendered(short, "conv_id", "piece", "long")
    if n == 0:
        return out
    pieces = _long_pieces(rows.join(ids, same, "left_semi")).select("conv_id", "piece", F.lit(True).alias("long"), "turns")
    return out.unionByName(_rendered(pieces, "conv_id", "piece", "long"))


# --- reading back ----------------------------------------------------------

def read_turns(formatted: DataFrame) -> DataFrame:
    """The pieces with their turns read back from the formatted text: array of
    (role, start, end, text); the role of turns in front of the first header of
    a piece is null."""
    f = F.col("formatted")
    zipped = F.arrays_zip(F.regexp_extract_all(f, F.lit(TOKEN), F.lit(0)).alias("token"),
                          F.slice(F.split(f, TOKEN, -1), F.lit(2), F.size(F.split(f, TOKEN, -1))).alias("text"))
    turn = "struct<role:string,start:bigint,end:bigint,text:string>"

    def add(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["token"])
        end = start + F.length(z["text"])
        header = z["token"].startswith(START)
        said = F.substr(z["token"], F.lit(len(START) + 1), F.length(z["token"]) - (len(START) + 1))
        role = F.when(header, unescaped_role(said)).otherwise(acc["role"])
        t = F.struct(role.alias("role"), start.alias("start"), end.alias("end"), z["text"].alias("text"))
        return F.struct(end.alias("at"), role.alias("role"),
                        F.when(z["token"] == END, acc["turns"]).otherwise(F.concat(acc["turns"], F.array(t))).alias("turns"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("role"),
                     F.expr(f"CAST(array() AS array<{turn}>)").alias("turns"))
    return formatted.withColumn("turns", F.aggregate(zipped, first, add)["turns"])


def _said(role: Column) -> Column:
    """role, line feed, text, line feed of every turn read back."""
    return F.array_join(F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], role), F.lit("\n"), unescaped(t["text"]), F.lit("\n"))), "")


def _learned() -> Column:
    """All text under the loss mask."""
    mine = F.filter("turns", lambda t: F.array_contains(
        "loss_spans", F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    return F.array_join(F.transform(mine, lambda t: unescaped(t["text"])), "")


def _stream_digests(batches):
    """Rows (conv_id, piece, said, learned, n_turns, chars) in order -> one row
    a conversation; holds one piece at a time beside the running hashes."""
    import pyarrow as pa
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, open_ = None, False

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]], types)], names)
    for b in batches:
        for i in range(b.num_rows):
            conv, said, learned, n, chars = (b.column(c)[i].as_py() for c in ("conv_id", "said", "learned", "n_turns", "chars"))
            if not open_ or conv != now[0]:
                if open_:
                    yield done()
                now, open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            now[1] += n
            now[2].update(said.encode("utf-8", "surrogatepass"))
            now[3] += len(learned)
            now[4].update(learned.encode("utf-8", "surrogatepass"))
            now[5] += chars
    if open_:
        yield done()


def digest(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from :func:`format_chats`' pieces."""
    spark = formatted.sparkSession
    written = shared_table(formatted, "chat-formatted")
    turns = read_turns(written)
    size = F.length("formatted").cast("long")
    short = turns.where("NOT long").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _said(F.lit("")).alias("said"),
        _learned().alias("learned"), size.alias("formatted_chars"))
    short = short.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
                         F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                         "formatted_chars")
    if written.where("long").isEmpty():
        return short
    workers_ready(spark)
    long = turns.where("long")
    # the role that a piece goes on with is the last one that a header before it named
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    roles = long.select("conv_id", "piece", F.element_at("turns", -1)["role"].alias("last"))
    roles = roles.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"),
                         F.last("last", ignorenulls=True).over(before).alias("goes_on"))
    pieces = long.join(roles, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p")))
    pieces = pieces.select(
        "conv_id", "piece", _said(F.coalesce("goes_on", F.lit(""))).alias("said"), _learned().alias("learned"),
        F.size("turns").cast("long").alias("n_turns"), size.alias("chars"))
    ordered = pieces.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "piece")
    return short.unionByName(ordered.mapInArrow(
        _stream_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
