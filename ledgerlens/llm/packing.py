"""Best-fit packing of documents into sequences (operator 9).

A document is its ids and an end id.  One longer than the sequence is cut
into full pieces behind a first piece that may be shorter; full pieces are
sequences of their own, so at most one piece of a document is left to pack.

Pieces are numbered where they are first written and dealt by a hash of that
number to shards of about ``SHARD_PIECES``, equal rows too.  In a shard
they are placed best fit, largest first; then a swap-based local search works
on the underfull bins: it takes the emptiest bin and moves a piece out of it,
exchanges one piece for a smaller one, one for two or two for one (all pairs
are looked at), always so that a bin no emptier gets fuller, which raises the
sum of squared fills; passes over the underfull bins repeat until in one no
bin has a step towards a fuller one.  Bins that stay underfull are dealt anew, fewer shards each round, and
packed again.

Defined results: null and empty texts are one piece of the end id; repeated
rows and null ids are documents of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, workers_ready
from .tokens import encoder, vocabulary_path

SEQUENCE = 1024
BLOCK_CHARS = 8_000_000         # characters encoded at a time: a batch is one block
UNITS_KEPT = 500_000            # cached units of a worker
SHARD_PIECES = 6_000
ROUNDS = 2                      # dealings; the last packs what earlier ones left underfull
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = 2,
           block_chars: int = BLOCK_CHARS, units_kept: int = UNITS_KEPT) -> DataFrame:
    """The pieces of every document with their ids' place and checksum;
    ``block_chars`` and ``units_kept`` trade a worker's memory for time."""
    workers_ready(docs.sparkSession)
    path = tokenizer or vocabulary_path()

    def cut(batches):
        enc, end = encoder(path, block_chars, units_kept), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for key, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % size + 1
                ends = range(first, n + 1, size)
                for i, e in enumerate(ends):
                    s = 0 if i == 0 else e - size
                    out["doc_id"].append(key)
                    out["piece"].append(i)
                    out["start"].append(s)
                    out["length"].append(e - s)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * s:4 * e]))
            yield pa.RecordBatch.from_pydict({
                k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins (lists of positions): largest piece first, into the fullest bin
    that takes it."""
    open_bins: dict[int, list[int]] = {}          # free space -> bins
    frees: list[int] = []                         # sorted free spaces with bins
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(frees, n)
        if at < len(frees):
            free = frees[at]
            which = open_bins[free].pop()
            if not open_bins[free]:
                frees.pop(at)
        else:
            free, which = size, len(bins)
            bins.append([])
        bins[which].append(i)
        left = free - n
        if left:
            if not open_bins.setdefault(left, []):
                bisect.insort(frees, left)
            open_bins[left].append(which)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that raise the sum of
    squared fills, in passes until one finds no step.  Bins that hold the same
    lengths are one kind, which is searched once however many bins it has."""
    bins = [sorted(b, key=lambda x: int(lengths[x])) for b in bins]
    kinds = [tuple(int(lengths[x]) for x in b) for b in bins]
    while _search_pass(bins, kinds, lengths, size):
        pass
    return [b for b in bins if b]


def _search_pass(bins: list[list[int]], kinds: list[tuple], lengths: np.ndarray, size: int) -> bool:
    """Let every underfull bin give once, the emptiest first; whether any
    step was made."""
    raised = False
    groups: dict[tuple, list[int]] = {}            # kind -> underfull bins in the search
    for i, k in enumerate(kinds):
        if k and sum(k) < size:
            groups.setdefault(k, []).append(i)

    def leave(kind):
        i = groups[kind].pop()
        if not groups[kind]:
            del groups[kind]
        return i

    heap = [(sum(k), k) for k in groups]
    heapq.heapify(heap)
    while heap:
        poor_kind = heap[0][1]                     # the emptiest kind gives
        if poor_kind not in groups:
            heapq.heappop(heap)
            continue
        poor = leave(poor_kind)
        changed = False
        while kinds[poor]:
            step = _best_step(kinds[poor], groups, size)
            if step is None:
                break
            give, kind, take = step
            other = leave(kind)
            given, taken = _out(bins[poor], give, lengths), _out(bins[other], take, lengths)
            bins[poor] += taken
            bins[other] += given
            for i in (poor, other):
                bins[i].sort(key=lambda x: int(lengths[x]))
                kinds[i] = tuple(int(lengths[x]) for x in bins[i])
            if sum(kinds[other]) < size:
                if kinds[other] not in groups:
                    heapq.heappush(heap, (sum(kinds[other]), kinds[other]))
                groups.setdefault(kinds[other], []).append(other)
            changed = raised = True
        if not changed:
            groups.pop(poor_kind, None)            # its like have no step either
    return raised


def _out(pieces_of: list[int], wanted: list[int], lengths: np.ndarray) -> list[int]:
    """Take pieces of these lengths out of a bin."""
    found = []
    for n in wanted:
        x = next(x for x in pieces_of if lengths[x] == n)
        pieces_of.remove(x)
        found.append(x)
    return found


@functools.lru_cache(maxsize=20_000)
def _pair_sums(kind: tuple) -> tuple[list[int], list[tuple[int, int]]]:
    """Sorted distinct sums of two pieces of a kind, with one pair for each."""
    once = sorted(set(kind))
    sums = {x + y: (x, y) for i, x in enumerate(once) for y in once[i + 1:]}
    sums |= {2 * x: (x, x) for x, n in Counter(kind).items() if n > 1}
    order = sorted(sums)
    return order, [sums[n] for n in order]


def _best_step(own: tuple, groups: dict[tuple, list[int]], size: int):
    """(given lengths, other kind, taken lengths) that fills another bin most:
    a move (gives one, takes none), one for one, one for two, or two for one;
    None when nothing helps.  The other bins must be at least as full, so
    every step raises the sum of squares."""
    others = list(groups)
    if not others:
        return None
    room = [size - sum(k) for k in others]
    once = [sorted(set(k)) for k in others]
    owner = np.repeat(np.arange(len(others)), [len(x) for x in once])
    sizes = np.fromiter((n for x in once for n in x), np.int64, len(owner))
    bin_free = np.array(room)
    free = bin_free[owner]
    best, found = 0, None
    for n in sorted(set(own), reverse=True):
        if n <= best:
            break
        fits = np.flatnonzero(bin_free >= n)
        if len(fits):                                               # move
            return [n], others[int(fits[np.argmin(bin_free[fits])])], []
        gain = n - sizes                                            # one for one
        ok = (gain > best) & (gain <= free)
        if ok.any():
            j = int(np.argmax(np.where(ok, gain, 0)))
            best, found = int(gain[j]), ([n], others[owner[j]], [int(sizes[j])])
        for k, f in zip(others, room):                              # one for two
            if len(k) > 1 and f > best and k[0] + k[1] < n - best:
                sums, pairs = _pair_sums(k)
                at = bisect.bisect_left(sums, n - f)
                if at < len(sums) and n - sums[at] > best:
                    best, found = n - sums[at], ([n], k, list(pairs[at]))
    if len(own) > 1:
        for n, pair in zip(*_pair_sums(own)):                       # two for one
            gain = n - sizes
            ok = (gain > best) & (gain <= free)
            if ok.any():
                j = int(np.argmax(np.where(ok, gain, 0)))
                best, found = int(gain[j]), (list(pair), others[owner[j]], [int(sizes[j])])
    return found


def pack_lengths(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


def _deal(rows: DataFrame, n: int, salt: int) -> DataFrame:
    shards = max(1, -(-n // SHARD_PIECES))
    key = F.xxhash64(F.lit(salt), "row")            # equal rows go apart
    return rows.withColumn("shard", F.pmod(key, F.lit(shards)))


def _placer(number: int, size: int):
    """Pack one shard: full pieces alone, the others by best fit and search."""
    def place(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        rows = rows.drop_columns("shard")
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names])
        lengths = rows.column("length").to_numpy()
        small = np.flatnonzero(lengths < size)
        bins = [[i] for i in np.flatnonzero(lengths >= size).tolist()]
        bins += [[int(small[i]) for i in b] for b in pack_lengths(lengths[small], size)]
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        closed = np.zeros(len(lengths), bool)
        base = (shard * ROUNDS + number) << 24
        for s, b in enumerate(bins):
            at = 0
            for i in b:
                ids[i], offsets[i] = base + s, at
                at += int(lengths[i])
            closed[b] = at == size
        return (rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
                .append_column("closed", pa.array(closed)))
    return place


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece (PIECES columns)."""
    spark = cut.sparkSession
    workers_ready(spark)
    # numbered once: the number is stored with the piece
    left = shared_table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done = []
    for number in range(ROUNDS):
        last = number == ROUNDS - 1
        n = left.count()
        placed = shared_table(
            _deal(left, n, number).groupBy("shard").applyInArrow(
                _placer(number, size), f"{PIECES}, row bigint, sequence_id bigint, offset bigint, closed boolean"), "packed")
        keep = placed if last else placed.where("closed")
        done.append(keep.drop("closed", "row"))
        left = placed.where("NOT closed").select(*left.columns)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
