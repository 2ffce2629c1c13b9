"""Near-duplicate documents by a signature-coordinate inverted join (operator 10).

Every text is its set of distinct word shingles (sorted 64-bit hashes) with a
MinHash signature of ``COORDS`` coordinates.  Equal sets form a class; classes
are posted under each coordinate-value pair.  Two classes are compared when
they share at least ``MATCHES`` of the coordinates:

* values held by one class only are counted, never posted (skips);
* of a class's values, in ascending order of frequency, only the first
  ``COORDS - MATCHES + 1`` are posted (prefix): a pair with enough matches
  shares one of them, and what is frequent is posted last;
* matches of a candidate pair are counted over whole signatures, and pairs at
  or above the threshold are confirmed on their full shingle sets (in long
  lists only if their smallest shingle hashes do not rule the link out).

Members of a posting list are not paired with each other outright.  First
each is paired with the list's pivot (the class with most shared values), and
links found so far are joined to components.  Then only classes that are
still in different components are paired: within short lists by a join, in
long lists block by block, as arrays, between the classes outside the largest
component and all members.  So a large group of copies costs its size, not its
square, and no pair of the list that could still matter is left out.

Two texts at the similarity bound are missed with a probability of about
4e-5 (fewer matches than ``MATCHES`` by chance) when nothing else links them.

Defined results: null texts and texts without words have the empty set, are
linked with nothing and kept; repeated rows have equal results; rows that
share an id are one document with the links of all their texts; a row with a
null id has component null, is linked with nothing and kept; an empty table
gives an empty result; columns of the input other than id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, ascii_words, mix64, shared_table, shingle_set, sliced, workers_ready

COORDS = 64
MATCHES = 38
SHORT = 24                      # longest list whose open pairs come from a join
BLOCK = 512                     # open classes of a long list compared at a time
SKETCH = 512                    # smallest shingle hashes looked at there
BROADCAST_IDS = 2_000_000       # ids broadcast at most when sets are fetched again
SIGNED = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, signature binary"


def _coordinates(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """32-bit minima of ``COORDS`` hash functions over a set."""
    low = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[i:i + 1024, None] * mult + add).min(axis=0))
    return (mix64(low) >> np.uint64(32)).astype("<u4")


def _functions(coords: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * coords + 1, dtype=np.uint64)
    draws = mix64(seeds * np.uint64(0x9E3779B97F4A7C15))
    return draws[:coords] | np.uint64(1), draws[coords:]


def signatures(docs: DataFrame, width: int, coords: int = COORDS) -> DataFrame:
    """Size, 128-bit hash and signature of every document's shingle set."""
    workers_ready(docs.sparkSession)

    def sign(batches):
        hasher, (mult, add) = WordHasher(), _functions(coords)
        for b in sliced(batches):
            out = {"doc_id": b.column("doc_id"), "n_shingles": [], "set_hi": [], "set_lo": [], "signature": []}
            for text in b.column("text").to_pylist():
                s = shingle_set(ascii_words(text), width, hasher)
                out["n_shingles"].append(len(s))
                both = np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
                hi, lo = mix64(both + np.uint64(len(s))).view(np.int64).tolist()
                out["set_hi"].append(hi)
                out["set_lo"].append(lo)
                out["signature"].append(_coordinates(s, mult, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                k: v if k == "doc_id" else pa.array(v, pa.binary() if k == "signature" else pa.int64())
                for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


def postings(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(value, cls, n, shared): the prefix of every class, values as
    coordinate-tagged 64-bit numbers; ``shared`` counts its posted-for values
    that other classes have."""
    def spread(batches):
        tag = (np.arange(coords, dtype=np.int64) << 32)
        for b in sliced(batches):
            sig = b.column("signature")
            vals = [np.frombuffer(x, "<u4").astype(np.int64) + tag for x in sig.to_pylist()]
            reps = np.repeat(np.arange(len(vals)), coords)
            yield pa.RecordBatch.from_pydict({
                "value": pa.array(np.concatenate(vals) if vals else np.empty(0, np.int64)),
                "cls": b.column("cls").take(pa.array(reps)), "n": b.column("n").take(pa.array(reps))})

    each = classes.select("cls", "n", "signature").mapInArrow(spread, "value bigint, cls bigint, n bigint")
    often = each.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    held = each.join(often, "value")
    # unshared values come first in the order of frequency, so they use up the prefix
    by_class = Window.partitionBy("cls").orderBy("freq", "value")
    whole = Window.partitionBy("cls")
    return (held.withColumns({"pos": F.row_number().over(by_class), "shared": F.count("*").over(whole)})
            .where(F.col("pos") <= F.col("shared") - matches + 1).select("value", "cls", "n", "shared"))


def _comparable(a: str, b: str, bound: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(F.col(a), F.col(b)) >= bound * F.greatest(F.col(a), F.col(b))


def _matching(pairs: DataFrame, classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``matches`` coordinates."""
    sig = classes.select("cls", "signature")
    both = (pairs.join(sig.withColumnsRenamed({"cls": "a", "signature": "sa"}), "a")
            .join(sig.withColumnsRenamed({"cls": "b", "signature": "sb"}), "b"))

    def count(batches):
        for t in sliced(batches):
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4").reshape(-1, coords) for c in ("sa", "sb"))
            ok = pa.array((x == y).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_pydict({c: t.column(c).filter(ok) for c in ("a", "b")})

    return both.select("a", "b", "sa", "sb").mapInArrow(count, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(cls, s): shingle sets of these classes, built again from their texts;
    with ``most`` only that many of the smallest hashes."""
    asked = shared_table(ids.distinct(), "asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("cls"), "text").join(side, "cls")

    def build(batches):
        hasher = WordHasher()
        for b in sliced(batches):
            sets = [shingle_set(ascii_words(t), width, hasher)[:most].tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"cls": b.column("cls"), "s": pa.array(sets, pa.binary())})

    return texts.mapInArrow(build, "cls bigint, s binary").distinct()


def _likely(own: np.ndarray, n_own: int, others: list[np.ndarray], n_others: np.ndarray, percent: int) -> np.ndarray:
    """Which sets can be similar to ``own``: judged by the sorted smallest
    hashes of both, exactly where these are whole sets, else with a margin of
    4.5 standard errors."""
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)
    top = own[-1] if len(own) < n_own else whole
    ok = np.zeros(len(others), bool)
    for j, (x, n) in enumerate(zip(others, n_others.tolist())):
        limit = min(top, x[-1]) if len(x) < n else top
        exact = limit == whole
        a, b = (own, x) if exact else (own[:np.searchsorted(own, limit, "right")], x[:np.searchsorted(x, limit, "right")])
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        common = int((a[at] == b).sum())
        union = len(a) + len(b) - common
        margin = 0.0 if exact else 450 * np.sqrt(percent / 100 * (1 - percent / 100) / union)
        ok[j] = 100 * common >= (percent - margin) * union
    return ok


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with 100 * |x & y| >= percent * |x | y| on full shingle sets."""
    pairs = shared_table(pairs, "pairs")
    sets = shared_table(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")), width), "sets")

    def verify(batches):
        for b in sliced(batches):
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({c: b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    both = (pairs.join(sets.withColumnsRenamed({"cls": "a", "s": "x"}), "a")
            .join(sets.withColumnsRenamed({"cls": "b", "s": "y"}), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): least id reachable, for every end of an edge.

    Labels fall to the least label of the neighbours, labelled nodes hook
    their label's node too, and labels are followed one step each round."""
    edges = shared_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                         .distinct(), "edges")
    labels = shared_table(edges.select(F.col("a").alias("cls")).distinct().withColumn("comp", F.col("cls")), "labels")
    while True:
        at = labels.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
        low = edges.join(at, "b").groupBy("a").agg(F.min("cb").alias("low"))
        near = labels.join(low, labels["cls"] == low["a"]).select("cls", "comp", "low")
        told = near.select("cls", F.least("comp", "low").alias("to")).union(
            near.select(F.col("comp").alias("cls"), F.least("comp", "low").alias("to")))
        fresh = told.groupBy("cls").agg(F.min("to").alias("comp"))
        step = fresh.select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
        fresh = shared_table(fresh.join(step, "comp").select("cls", F.col("next").alias("comp")), "labels")
        old = labels.select("cls", F.col("comp").alias("old"))
        if fresh.join(old, "cls").where("comp <> old").isEmpty():
            return fresh
        labels = fresh


def _with_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    return (posts.join(labels, "cls", "left")
            .withColumn("comp", F.coalesce("comp", "cls")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _long_lists(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int,
                coords: int, matches: int) -> DataFrame:
    """Likely pairs of different components in long lists: enough matches, and
    similar by their ``SKETCH`` smallest shingle hashes.

    Classes outside a list's largest component (open) are split into blocks;
    every member visits each block of open classes of its list, and members
    are dealt into blocks too, so a task holds two blocks at a time.  A pair
    that meets in several lists is told in that of its first coordinate."""
    coord = F.shiftright("value", 32).cast("int")
    held = members.groupBy("cls").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftright(value, 32) AS int))")).alias("lists"))
    each = (held.join(classes.select("cls", "signature"), "cls")
            .join(_sets(docs, members.select("cls"), width, SKETCH), "cls"))
    sizes = members.groupBy("value", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("value").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"),
                                      (F.sum("c") - F.max("c")).alias("n_open"), F.sum("c").alias("n_all"))
    m = (members.join(main, "value").withColumn("open", F.col("comp") != F.col("main"))
         .withColumns({"ob": F.ceil(F.col("n_open") / BLOCK).cast("int"), "mb": F.ceil(F.col("n_all") / (4 * BLOCK)).cast("int"),
                       "h": F.xxhash64("cls")})
         .withColumn("coord", coord).join(each, "cls"))
    mine = F.pmod("h", "mb").cast("int")
    as_member = m.select("value", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("x"), mine.alias("y"),
                         F.lit(False).alias("asks"), "cls", "comp", "n", "coord", "lists", "signature", "s")
    as_open = m.where("open").select("value", F.pmod("h", "ob").cast("int").alias("x"),
                                     F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("y"),
                                     F.lit(True).alias("asks"), "cls", "comp", "n", "coord", "lists", "signature", "s")

    def compare(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        cls, comp, n = (rows.column(c).to_numpy() for c in ("cls", "comp", "n"))
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(-1, coords)
        lists, coord = rows.column("lists").to_numpy().view(np.uint64), rows.column("coord")[0].as_py()
        earlier = np.arange(coord, dtype=np.uint64)
        sketches = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [], []
        for i in left:
            ok = right[(comp[right] != comp[i])
                       & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            same = sig[ok] == sig[i]
            here = same.sum(axis=1) >= matches
            ok, same = ok[here], same[here][:, :coord]
            both = (lists[ok] & lists[i])[:, None] >> earlier & np.uint64(1)
            ok = ok[~(same & (both == 1)).any(axis=1)]
            ok = ok[_likely(sketches[i], int(n[i]), [sketches[j] for j in ok], n[ok], percent)]
            a += [int(cls[i])] * len(ok)
            b += cls[ok].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return as_member.union(as_open).groupBy("value", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def link(docs: DataFrame, width: int = 5, percent: int = 80, coords: int = COORDS,
         matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    signed = shared_table(signatures(docs, width, coords), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    keys = ["set_hi", "set_lo", "n_shingles"]
    classes = shared_table(known.groupBy(*keys).agg(F.min("doc_id").alias("cls"), F.first("signature").alias("signature"))
                           .withColumnRenamed("n_shingles", "n"), "classes")
    posts = shared_table(postings(classes, coords, matches), "postings")

    pivot = posts.groupBy("value").agg(F.max_by("cls", F.struct("shared", -F.col("cls"))).alias("p"),
                                       F.max_by("n", F.struct("shared", -F.col("cls"))).alias("pn"),
                                       F.count("*").alias("size")).where("size > 1")
    bound = percent / 100.0
    stars = posts.join(pivot, "value").where(_comparable("n", "pn", bound)).select(
        F.col("p").alias("a"), F.col("cls").alias("b"))
    first = shared_table(_confirmed(_matching(_ordered(stars), classes, coords, matches), docs, width, percent), "links")
    labels = components(first)

    members = _with_labels(posts, labels)
    spans = members.groupBy("value").agg(F.count("*").alias("size"), F.min("comp").alias("lo"),
                                         F.max("comp").alias("hi")).where("lo <> hi").select("value", "size")
    members = shared_table(members.join(spans, "value"), "open-lists")
    short = members.where(F.col("size") <= SHORT)
    x = short.select("value", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
    y = short.select("value", F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    near = x.join(y, "value").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                                    & _comparable("na", "nb", bound)).select("a", "b").distinct()
    rest = _matching(near, classes, coords, matches).union(
        _long_lists(members.where(F.col("size") > SHORT), classes, docs, width, percent, coords, matches))
    second = _confirmed(_ordered(rest), docs, width, percent)
    links = shared_table(first.union(second), "links")
    # an id on different texts joins their classes
    several = shared_table(known.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
                           .where("lo <> hi").select("doc_id"), "several")
    n = several.count()
    if n:
        texts = known.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id").select("doc_id", *keys).distinct()
        links = links.union(texts.join(classes.withColumnRenamed("n", "n_shingles"), keys)
                            .select(F.col("doc_id").alias("a"), F.col("cls").alias("b")))
    comp = components(links)

    named = classes.select(F.col("set_hi"), F.col("set_lo"), F.col("n").alias("n_shingles"), "cls").join(comp, "cls", "left")
    named = named.select(*keys, F.coalesce("comp", "cls").alias("component_id"))
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (signed.drop("signature").join(named, keys, "left")
            .withColumn("component_id", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")))
