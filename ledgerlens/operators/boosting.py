"""Boosted regression trees with the analysed model's settings.

Second-order boosting for squared error: every round grows one tree from the
gradients of the predictions so far; a split is chosen by its gain

    T(G_l)^2 / (H_l + l2) + T(G_r)^2 / (H_r + l2) - T(G)^2 / (H + l2)

with gradient sum G, row count H (the hessian of squared error is 1) and T the
L1 soft threshold; a leaf answers -rate * T(G) / (H + l2).  Rows and columns
are drawn per tree; the ensemble is cut at its best validation round once
``patience`` rounds brought no better one.

The rows stay on the executors, as blocks of binned values, a column after the
other.  A level of all targets' trees is one distributed pass: tasks add up
gradients and counts per (target, node, feature, bin), a shuffle by (target,
node) merges them, and the task that holds a node's merged sums picks its
split.  The driver gets a few numbers a node, whatever the number of rows,
features and bins.  This loop of many small passes over the same blocks is why
an RDD is used here.  Rows that fit one block are grown without passes.

Trees are walked for all rows of a block at once (:func:`paths`): each node's
comparison is a packed bit a row, and the bits of a path are chosen bottom-up.

Gradients are summed as whole numbers (2^30 steps of the largest target), row
draws are hashes of the row's key, so the trees do not depend on how rows are
dealt to tasks, and a lost block is computed again to the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

STEPS = 2.0 ** 30               # steps of the largest |target| in a summed gradient
BLOCK_ROWS = 2 ** 19            # rows of a block at most; sums of 2^19 gradients are exact in doubles
BLOCK_VALUES = 2 ** 26          # binned values of a block at most, a byte each
PIECE_ROWS = 16_384             # rows that a task bins at once, at most
WALKED_ROWS = 65_536            # rows whose paths are found at once, about
RENEW = 10                      # rounds after which blocks take in the trees grown since


@dataclass(frozen=True)
class BoostConfig:
    """Settings of the analysed model; ``bins`` is ours."""
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least_rows: int = 3
    patience: int | None = 30
    seed: int = 42
    bins: int = 32


# Settings of the fallback trainer (no validation, no row minimum beyond one).
FALLBACK = BoostConfig(rounds=200, depth=5, least_rows=1, patience=None)


@dataclass
class Tree:
    """Nodes in order of creation; ``left < 0`` marks a leaf."""
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, v in zip((self.feature, self.bin, self.left, self.right, self.value, self.rows, self.gain),
                             (-1, -1, -1, -1, value, rows, 0.0)):
            column.append(v)
        return len(self.value) - 1

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Node in which every row of binned values (features x rows) ends."""
        ends, out = path_ends(self.left, self.right), np.empty(x.shape[1], np.int64)
        for lo in range(0, len(out), WALKED_ROWS):
            some = x[:, lo: lo + WALKED_ROWS]
            codes = paths(self.left, self.right, some.shape[1], lambda j: np.packbits(some[self.feature[j]] > self.bin[j]))
            np.take(ends, codes, out=out[lo: lo + WALKED_ROWS], mode="clip")
        return out


def path_ends(left: list, right: list) -> np.ndarray:
    """Leaf of every path code (see :func:`paths`) of a tree."""
    at = [(0, 0, 0)]
    for node, code, depth in at:                                    # grows as it goes
        if left[node] >= 0:
            at += [(left[node], code, depth + 1), (right[node], code | 1 << depth, depth + 1)]
    out = np.zeros(1 << max(depth for *_, depth in at), np.int64)
    for node, code, _ in at:
        if left[node] < 0:
            out[code] = node
    return out


def paths(left: list, right: list, n: int, right_of) -> np.ndarray:
    """Each of ``n`` rows' path code: bit d is set where the row goes right at
    depth d.  ``right_of(node)`` gives the rows right of its split as packed
    bits."""
    def below(node: int) -> list[np.ndarray]:
        if left[node] < 0:
            return []
        here = right_of(node)
        a, b = below(left[node]), below(right[node])
        bits = [x ^ ((x ^ y) & here) for x, y in zip(a, b)]
        bits += [x & ~here for x in a[len(bits):]] if len(a) > len(b) else [y & here for y in b[len(bits):]]
        return [here, *bits]
    bits = below(0)
    codes = np.zeros(n, np.uint8 if len(bits) <= 8 else np.uint32)
    for d, packed in enumerate(bits):
        codes |= np.unpackbits(packed, count=n).astype(codes.dtype, copy=False) << d
    return codes


@dataclass
class Boosted:
    """A fitted ensemble of one target."""
    target: str
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    errors: list[float]         # validation RMSE after each grown round
    grown: int                  # rounds grown before stopping

    @property
    def best(self) -> int:
        return len(self.trees)

    def node_rows(self) -> list[tuple]:
        """(target, tree, node, feature, threshold, left, right, value, n_rows, gain)."""
        return [(self.target, t, i, self.features[f] if f >= 0 else None, self.cuts[f][b] if f >= 0 else None,
                 left, right, v, n, g)
                for t, tree in enumerate(self.trees)
                for i, (f, b, left, right, v, n, g) in enumerate(zip(
                    tree.feature, tree.bin, tree.left, tree.right, tree.value, tree.rows, tree.gain))]

    def importance(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits, as shares of their sum."""
        total, count = dict.fromkeys(self.features, 0.0), dict.fromkeys(self.features, 0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[self.features[f]] += g
                    count[self.features[f]] += 1
        mean = {n: total[n] / count[n] if count[n] else 0.0 for n in self.features}
        whole = sum(mean.values())
        return [(n, m / whole if whole else 0.0) for n, m in mean.items()]


NODES = ("target string, tree int, node int, feature string, threshold double, left int, right int, "
         "value double, n_rows long, gain double")


def node_table(spark: SparkSession, models: list[Boosted]) -> DataFrame:
    """All nodes of the models' trees."""
    return spark.createDataFrame([r for m in models for r in m.node_rows()], NODES)


# --- draws -----------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(seed: int, round_: int) -> np.uint64:
    return _mixed(np.array([(seed << 20) + round_ + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def drawn_columns(n: int, share: float, seed: int, round_: int) -> np.ndarray:
    """The columns of a round's tree: the share with the least hashes."""
    h = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _salt(seed, round_))
    return np.sort(np.argsort(h, kind="stable")[: max(1, int(share * n))])


def drawn_rows(keys: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    return (_mixed(keys ^ _salt(seed, round_)) >> np.uint64(11)).astype(np.float64) < share * 2.0 ** 53


# --- blocks ----------------------------------------------------------------

def cut_points(matrix: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Quantiles of every feature over the training rows, at most ``bins - 1``
    each and below the largest value (exact up to 100,000 rows, else ranks
    within 1e-5)."""
    at = [i / bins for i in range(1, bins)]
    train = matrix.where("split = 'train'")
    one = train.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 100_000).alias(f"q{i}") for i, f in enumerate(features)],
                    *[F.max(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(v) for v in one[f"q{i}"] or () if v < one[f"m{i}"]}) for i in range(len(features))]


def _packing(cuts: list[list[float]], n_targets: int):
    """Arrow task: rows (key, val, targets, values) -> one row a piece."""
    def run(batches):
        from pyspark import TaskContext
        piece = TaskContext.get().partitionId()
        for b in batches:
            for lo in range(0, b.num_rows, PIECE_ROWS):
                s = b.slice(lo, PIECE_ROWS)
                n = s.num_rows
                v = s.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
                bins = np.empty((len(cuts), n), np.uint8)
                for j, c in enumerate(cuts):
                    bins[j] = np.searchsorted(c, v[:, j], side="left")
                y = s.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, n_targets)
                keys = s.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
                val = s.column("val").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (bins, y.astype(np.float64), keys, val))],
                    ["piece", "bins", "y", "keys", "val"])
    return run


def _blocks(matrix: DataFrame, features: list[str], targets: list[str], cuts: list[list[float]], base: list[float], n: int):
    """Persisted RDD of (bins (features x rows), targets, keys, validation
    flags, predictions), one block a partition.  The ``n`` rows are binned in
    pieces and the pieces dealt to blocks: one where the rows fit it, else as
    many as there are cores, or more to keep blocks small."""
    keys = [c for c in ("company", "year") if c in matrix.columns] or features
    rows = matrix.where("split IN ('train', 'val')").select(
        F.xxhash64(*keys).alias("key"), (F.col("split") == "val").alias("val"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
        F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    width, t, first = len(features), len(targets), np.array(base)
    n_blocks = -(-n // max(1, min(BLOCK_ROWS, BLOCK_VALUES // width)))
    if n_blocks > 1:
        n_blocks = max(n_blocks, matrix.sparkSession.sparkContext.defaultParallelism)
    pieces = n_blocks * -(-n // (n_blocks * PIECE_ROWS))            # as many for every block
    table = cut_lineage(rows.repartition(pieces).mapInArrow(
        _packing(cuts, t), "piece int, bins binary, y binary, keys binary, val binary"))

    def opened(r):
        y = np.frombuffer(r["y"]).reshape(-1, t)
        return (np.frombuffer(r["bins"], np.uint8).reshape(width, -1), y, np.frombuffer(r["keys"], np.int64).view(np.uint64),
                np.frombuffer(r["val"], np.uint8).astype(bool), np.tile(first, (len(y), 1)))

    def joined(part):
        part = [opened(r) for r in part]
        return [(np.concatenate([p[0] for p in part], axis=1), *map(np.concatenate, list(zip(*part))[1:]))] if part else []
    if n_blocks == 1:
        dealt = table.rdd.coalesce(1)
    else:
        dealt = table.rdd.map(lambda r: (r["piece"], r)).partitionBy(n_blocks, lambda piece: piece % n_blocks).values()
    return dealt.mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK)


def _grown(block, pending: list[list[Tree]]):
    """The block with the pending trees of every target in its predictions."""
    bins, y, keys, val, f = block
    if not any(pending):
        return block
    f = f.copy()
    for k, trees in enumerate(pending):
        for tree in trees:
            f[:, k] += np.array(tree.value)[tree.leaves_of(bins)]
    return bins, y, keys, val, f


def _cell_sums(x: np.ndarray, columns: np.ndarray, rows: np.ndarray, node: np.ndarray, g: np.ndarray, n_nodes: int, bins: int) -> np.ndarray:
    """Sums of ``g`` and row counts per (node, column, bin) of the listed rows.
    Many rows are added up for two columns at once, in cells of their pairs of
    bins, and a column's sums taken from these."""
    out = np.empty((n_nodes, len(columns), bins, 2), np.int64)
    paired = len(rows) >= 4 * n_nodes * bins * bins
    first = {w: node * bins ** w for w in range(1, 2 + paired)}
    for lo in range(0, len(columns), 1 + paired):
        some = columns[lo: lo + 1 + paired]
        size, cell = bins ** len(some), x[some[0]].take(rows)
        if len(some) == 2:
            cell = cell.astype(np.uint16) * np.uint16(bins) + x[some[1]].take(rows)
        cell = first[len(some)] + cell
        for i, sums in enumerate((np.bincount(cell, g, n_nodes * size), np.bincount(cell, minlength=n_nodes * size))):
            if len(some) == 1:
                out[:, lo, :, i] = sums.reshape(n_nodes, bins)
            else:
                sums = sums.reshape(n_nodes, bins, bins)
                out[:, lo, :, i], out[:, lo + 1, :, i] = sums.sum(axis=2), sums.sum(axis=1)
    return out


def _histograms(block, growing: dict, drawn: np.ndarray, columns: np.ndarray, scale: np.ndarray, bins: int) -> dict:
    """Gradient sums and counts of a block: {target: (open nodes, columns, bins, 2)}."""
    x, y, _, _, f = block
    out = {}
    for k, (tree, open_) in growing.items():
        slot = np.full(len(tree.value), -1)
        slot[open_] = np.arange(len(open_))
        node = slot[tree.leaves_of(x)]
        rows = np.flatnonzero(drawn & (node >= 0))
        g = np.rint((f[rows, k] - y[rows, k]) * scale[k])
        out[k] = _cell_sums(x, columns, rows, node[rows], g, len(open_), bins)
    return out


def _histograms_in_task(block, tree: Tree, open_: list[int], k: int, drawn: np.ndarray, columns: np.ndarray, scale: np.ndarray,
                        bins: int, before: dict) -> np.ndarray:
    """The open nodes' histograms of a block that holds all rows: of two
    children the one of fewer rows is added up, the other is what it leaves of
    its parent's sums (whole numbers).  ``before`` has the level above by node."""
    pairs = [(i, *((a, b) if tree.rows[a] <= tree.rows[b] else (b, a)))
             for i in before for a, b in [(tree.left[i], tree.right[i])] if a >= 0]
    few = [a for _, a, _ in pairs] or open_
    found = dict(zip(few, _histograms(block, {k: (tree, few)}, drawn, columns, scale, bins)[k]))
    for i, a, b in pairs:
        found[b] = before[i] - found[a]
    before.clear()
    before.update(found)
    return np.stack([found[i] for i in open_])


def _squared_error(block, k: int, scale: np.ndarray) -> int:
    """Validation errors of a block, squared and summed in whole steps."""
    _, y, _, val, f = block
    e = (f[val, k] - y[val, k]) * scale[k] / 2.0 ** 10
    return int(np.rint(e * e).sum())


def _node_splits(hist: np.ndarray, scale: float, cfg: BoostConfig) -> list[tuple]:
    """(gradient sum, rows, best split) of every open node of a histogram."""
    return [(int(g), int(h), split) for (g, h), split in zip(hist[:, 0].sum(axis=1), best_splits(hist, scale, cfg))]


def _level(blocks, pending, growing: dict, round_: int, cfg: BoostConfig, columns: np.ndarray, scale: np.ndarray, bins: int,
           watched=()) -> tuple[dict, dict]:
    """One pass over all blocks: the splits of the growing trees' open nodes,
    and the summed squared validation errors of the watched targets.  A node's
    histograms meet in one task, which picks the split."""
    def summed(part):
        total = {}
        for block in part:
            block = _grown(block, pending)
            found = {(k, i): node for k, h in _histograms(block, growing, _drawn(block, round_, cfg), columns, scale, bins).items()
                     for i, node in enumerate(h)}
            for key, h in [*found.items(), *(((k, -1), _squared_error(block, k, scale)) for k in watched)]:
                total[key] = total[key] + h if key in total else h
        return list(total.items())

    def picked(part):
        total = {}
        for key, h in part:
            total[key] = total[key] + h if key in total else h
        return [(key, h if key[1] < 0 else _node_splits(h[None], scale[key[0]], cfg)[0]) for key, h in total.items()]
    place = {key: i for i, key in enumerate([(k, i) for k, (_, open_) in growing.items() for i in range(len(open_))]
                                            + [(k, -1) for k in watched])}
    tasks = min(len(place), blocks.getNumPartitions())
    found = dict(blocks.mapPartitions(summed).partitionBy(tasks, place.__getitem__).mapPartitions(picked).collect())
    return {k: [found[k, i] for i in range(len(open_))] for k, (_, open_) in growing.items()}, {k: found[k, -1] for k in watched}


def _errors(blocks, pending, ks: list[int], scale: np.ndarray) -> dict:
    """One pass: summed squared validation errors of the targets."""
    def of_block(block):
        block = _grown(block, pending)
        return [_squared_error(block, k, scale) for k in ks]
    zero = [0] * len(ks)
    total = blocks.aggregate(zero, lambda acc, block: [a + e for a, e in zip(acc, of_block(block))],
                             lambda a, b: [x + y for x, y in zip(a, b)])
    return dict(zip(ks, total))


def _drawn(block, round_: int, cfg: BoostConfig) -> np.ndarray:
    return ~block[3] & drawn_rows(block[2], cfg.row_share, cfg.seed, round_)


# --- growing ---------------------------------------------------------------

def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, cfg: BoostConfig) -> float:
    return float(-cfg.rate * _soft(np.float64(g), cfg.l1) / (h + cfg.l2))


def best_splits(hist: np.ndarray, scale: float, cfg: BoostConfig) -> list[tuple | None]:
    """(gain, column, bin, left G, left H, right G, right H) of every open node
    of a histogram; None where no split gains.  Ties go to the first column and
    bin."""
    total = hist[:, 0].sum(axis=1)                                   # (nodes, 2)
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    (gl, hl), (gr, hr) = ((p[..., 0] / scale, p[..., 1].astype(float)) for p in (left, right))
    g, h = total[:, 0] / scale, total[:, 1].astype(float)

    def part(a, b):
        return _soft(a, cfg.l1) ** 2 / (b + cfg.l2)
    gain = part(gl, hl) + part(gr, hr) - part(g, h)[:, None, None]
    gain = np.where((hl >= cfg.least_rows) & (hr >= cfg.least_rows), gain, -1.0)
    out = []
    for i in range(len(hist)):
        at = int(gain[i].argmax())
        c, b = divmod(at, gain.shape[2])
        out.append((float(gain[i, c, b]), c, b, *(float(p[i, c, b]) for p in (gl, hl, gr, hr)))
                   if gain[i, c, b] > 1e-12 else None)
    return out


def grow(splits, ks: list[int], n_features: int, round_: int, cfg: BoostConfig, scale: np.ndarray) -> dict[int, Tree]:
    """One tree a target; ``splits(growing, columns)`` finds the splits of one
    level of all of them (see ``_node_splits``), on the cluster or in a task
    that holds all rows."""
    columns = drawn_columns(n_features, cfg.column_share, cfg.seed, round_)
    growing = {k: (Tree(), [0]) for k in ks}
    for tree, _ in growing.values():
        tree.add(0.0, 0)
    for depth in range(cfg.depth):
        todo = {k: v for k, v in growing.items() if v[1]}
        if not todo:
            break
        found = splits(todo, columns)
        for k, (tree, open_) in todo.items():
            after = []
            if depth == 0:
                g, h, _ = found[k][0]
                tree.value[0], tree.rows[0] = leaf_value(g / scale[k], h, cfg), h
            for node, (_, _, split) in zip(open_, found[k]):
                if split is None:
                    continue
                gain, c, b, gl, hl, gr, hr = split
                tree.feature[node], tree.bin[node], tree.gain[node] = int(columns[c]), b, gain
                tree.left[node], tree.right[node] = tree.add(leaf_value(gl, hl, cfg), int(hl)), tree.add(leaf_value(gr, hr, cfg), int(hr))
                after += [tree.left[node], tree.right[node]]
            growing[k] = (tree, after)
    return {k: tree for k, (tree, _) in growing.items()}


def _grow_in_task(block, k: int, first: int, last: int, cfg: BoostConfig, scale: np.ndarray, bins: int) -> list[tuple]:
    """(tree, squared validation error after it) of rounds first to last, for a
    training set that is one block."""
    out = []
    for round_ in range(first, last):
        drawn, before = _drawn(block, round_, cfg), {}

        def splits(growing, columns):
            found = _histograms_in_task(block, *growing[k], k, drawn, columns, scale, bins, before)
            return {k: _node_splits(found, scale[k], cfg)}
        tree = grow(splits, [k], len(block[0]), round_, cfg, scale)[k]
        alone = [[] for _ in range(block[1].shape[1])]
        alone[k] = [tree]
        block = _grown(block, alone)
        out.append((tree, _squared_error(block, k, scale)))
    return out


def _next_rounds(blocks, pending, going: list[int], round_: int, cfg: BoostConfig, scale: np.ndarray, bins: int,
                 n_features: int, watched: bool, ahead: dict) -> dict[int, list[tuple]]:
    """{target: [(tree, error)]} of the next round or rounds.

    Rows that are one block are grown in memory by a task per target, several
    rounds at once, as in PLANET's second phase; more rows by a pass a level.
    The pass that takes a round's errors also takes the first level of the next
    round, kept in ``ahead``.  Both ways run the same functions on the same
    whole numbers and give the same trees."""
    if blocks.getNumPartitions() == 1:
        last = min(cfg.rounds, round_ + RENEW)
        tasks = [blocks.map(lambda block, k=k: (k, _grow_in_task(block, k, round_, last, cfg, scale, bins))) for k in going]
        return dict(blocks.context.union(tasks).collect())

    def splits(growing, columns):
        if ahead and all(len(tree.value) == 1 for tree, _ in growing.values()):
            found = dict(ahead)
            ahead.clear()
            return found
        return _level(blocks, pending, growing, round_, cfg, columns, scale, bins)[0]
    trees = grow(splits, going, n_features, round_, cfg, scale)
    if not watched:
        return {k: [(trees[k], 0)] for k in going}
    after = [p + ([trees[k]] if k in trees else []) for k, p in enumerate(pending)]
    if round_ + 1 < cfg.rounds and cfg.depth:
        seeds = {k: (Tree(), [0]) for k in going}
        for tree, _ in seeds.values():
            tree.add(0.0, 0)
        found, off = _level(blocks, after, seeds, round_ + 1, cfg, drawn_columns(n_features, cfg.column_share, cfg.seed, round_ + 1),
                            scale, bins, going)
        ahead.update(found)
    else:
        off = _errors(blocks, after, going, scale)
    return {k: [(trees[k], off[k])] for k in going}


def train(matrix: DataFrame, features: list[str], targets: list[str], cfg: BoostConfig = BoostConfig()) -> dict[str, Boosted]:
    """One ensemble per target from the rows of split ``train``; rows
    of split ``val`` only decide when to stop.  Rows need their targets;
    missing feature values count as 0."""
    spark = matrix.sparkSession
    ship_package(spark)
    cuts = cut_points(matrix, features, cfg.bins)
    known = [F.col(t).cast("double") for t in targets]
    stats = matrix.where("split IN ('train', 'val')").agg(
        F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n"),
        *[F.max(F.abs(y)).alias(f"m{i}") for i, y in enumerate(known)]).first()
    scale = np.array([STEPS / (stats[f"m{i}"] or 1.0) for i in range(len(targets))])
    sums = matrix.where("split = 'train'").agg(*[
        F.sum(F.rint(y * float(scale[i])).cast("decimal(20,0)")).alias(f"s{i}") for i, y in enumerate(known)]).first()
    base = [float(sums[f"s{i}"] or 0) / float(scale[i]) / max(1, stats["n"]) for i in range(len(targets))]
    if not stats["n"] or not features:
        return {t: Boosted(t, features, cuts, base[k], [], [], 0) for k, t in enumerate(targets)}
    blocks = _blocks(matrix, features, targets, cuts, base, stats["n"] + stats["n_val"])
    bins = max(2, 1 + max(map(len, cuts)))
    watched = cfg.patience is not None and stats["n_val"] > 0
    trees, errors, pending, going, round_, renewed, ahead = [[] for _ in targets], [[] for _ in targets], [[] for _ in targets], \
        list(range(len(targets))), 0, 0, {}

    def waited_long(k: int) -> bool:
        return watched and bool(errors[k]) and len(errors[k]) - 1 - int(np.argmin(errors[k])) >= cfg.patience
    while round_ < cfg.rounds and going:
        found = _next_rounds(blocks, pending, going, round_, cfg, scale, bins, len(features), watched, ahead)
        round_ += max(len(v) for v in found.values())
        for k, grown in found.items():
            for tree, off in grown:
                if not waited_long(k):
                    trees[k].append(tree)
                    pending[k].append(tree)
                    errors[k].append(float(off / max(1, stats["n_val"])) ** 0.5 / float(scale[k]) * 2.0 ** 10)
        going = [k for k in going if not waited_long(k)]
        if round_ - renewed >= RENEW and round_ < cfg.rounds and going:
            renewed = round_
            now = blocks.map(lambda block, trees=[list(p) for p in pending]: _grown(block, trees)).persist(StorageLevel.MEMORY_AND_DISK)
            if round_ % (5 * RENEW) == 0:
                now.checkpoint()
            now.count()
            blocks.unpersist()
            blocks, pending = now, [[] for _ in targets]
    blocks.unpersist()
    best = [1 + int(np.argmin(errors[k])) if watched else len(trees[k]) for k in range(len(targets))]
    return {t: Boosted(t, features, cuts, base[k], trees[k][: best[k]], errors[k] if watched else [], len(trees[k]))
            for k, t in enumerate(targets)}


# --- scoring ---------------------------------------------------------------

def _case(nodes: dict[int, tuple], at: int, number) -> str:
    feature, threshold, left, right, value = nodes[at]
    if left < 0:
        return number(value)
    return (f"CASE WHEN coalesce({feature}, {number(0.0)}) <= {number(threshold)} THEN {_case(nodes, left, number)} "
            f"ELSE {_case(nodes, right, number)} END")


def spark_number(v: float) -> str:
    return f"{float(v)!r}D"


def portable_number(v: float) -> str:
    """A double that Spark SQL and other engines read to the same bits."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def tree_texts(nodes: list[tuple], number=spark_number) -> list[str]:
    """Each tree of one target's node rows (see ``NODES``) as a SQL expression;
    a missing feature value counts as 0 (C11)."""
    trees: dict[int, dict[int, tuple]] = {}
    for _, tree, node, feature, threshold, left, right, value, *_ in nodes:
        trees.setdefault(tree, {})[node] = (feature, threshold, left, right, value)
    return [_case(trees[t], 0, number) for t in sorted(trees)]


def score_text(base: float, nodes: list[tuple], number=spark_number) -> str:
    """base + tree + tree ..., added in the order of the trees."""
    return " + ".join([number(base), *tree_texts(nodes, number)])


def tree_scorer(models: dict[str, Boosted]):
    """A scorer (see ``scenarios.linear_scorer``) from ensembles of a few
    hundred nodes, as one Spark expression a target; features that the frame
    lacks count as 0.  Longer expressions are beyond what the code generator
    compiles: :func:`arrow_scorer` gives the same bits."""
    def score(df: DataFrame, targets: list[str]) -> DataFrame:
        have = set(df.columns)
        out = {}
        for t in targets:
            rows = [r if r[3] is None or r[3] in have else (*r[:3], "0D", *r[4:]) for r in models[t].node_rows()]
            out[f"predicted_{t}"] = F.expr(score_text(models[t].base, rows))
        return df.withColumns(out)
    return score


def _scored(x: np.ndarray, splits: list[tuple[int, list[float]]], models: list[tuple]) -> np.ndarray:
    """Predictions (rows x models) for values (features x rows).  ``splits``
    are the cuts made anywhere, each compared once; a model is its base and per
    tree (left, right, numbers of its nodes' splits, leaf values by path code)."""
    bits = [np.packbits(~(x[at] <= cut)) for at, cuts in splits for cut in cuts]
    out = np.empty((x.shape[1], len(models)))
    for k, (base, trees) in enumerate(models):
        total = np.full(len(out), base)
        for left, right, made, value in trees:
            total += value.take(paths(left, right, len(out), lambda j: bits[made[j]]), mode="clip")
        out[:, k] = total
    return out


def _gathered(batches, rows: int):
    """Lists of batches of about so many rows together."""
    some = []
    for b in batches:
        some.append(b)
        if sum(map(len, some)) >= rows:
            yield some
            some = []
    if some:
        yield some


def arrow_scorer(models: dict[str, Boosted]):
    """A scorer from ensembles of any size: an Arrow function of the feature
    values only, the frame's other columns stay in the JVM."""
    names = sorted({f for m in models.values() for f in m.features})
    cut: dict[str, set] = {f: set() for f in names}
    for m in models.values():
        for tree in m.trees:
            for f, b in zip(tree.feature, tree.bin):
                if f >= 0:
                    cut[m.features[f]].add(m.cuts[f][b])
    splits = [(i, sorted(cut[f])) for i, f in enumerate(names)]
    number = {s: i for i, s in enumerate((names[i], c) for i, cuts in splits for c in cuts)}
    ready = {t: (m.base, [(tree.left, tree.right, [number[m.features[f], m.cuts[f][b]] if f >= 0 else -1 for f, b in zip(tree.feature, tree.bin)],
                           np.array(tree.value)[path_ends(tree.left, tree.right)]) for tree in m.trees]) for t, m in models.items()}

    def score(df: DataFrame, targets: list[str]) -> DataFrame:
        ship_package(df.sparkSession)
        have = set(df.columns)

        @F.arrow_udf("array<double>")
        def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for some in _gathered(batches, WALKED_ROWS):
                x = [b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(names)).T for b in some]
                scores, lo = _scored(np.concatenate(x, axis=1), splits, [ready[t] for t in targets]), 0
                for b in some:
                    here = scores[lo: lo + len(b)]
                    lo += len(b)
                    yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(targets)), pa.array(here.ravel()))
        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in names])
        df = df.withColumn("_predicted", predicted(x))
        return df.withColumns({f"predicted_{t}": F.col("_predicted")[k] for k, t in enumerate(targets)}).drop("_predicted")
    return score
