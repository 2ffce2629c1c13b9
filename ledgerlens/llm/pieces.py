"""SentencePiece encoding by sampled segmentations, and decoding (operator 7).

The pieces of a SentencePiece vocabulary span a lattice over a text (blanks
written as U+2581).  Piece ``i`` of ``n`` has weight ``1 / (rank + 1)``, its
Zipf weight by score rank, to the power ``ALPHA``.  Forward filtering sums the
weights of all paths to every position; backward sampling then draws the last
piece of the text, the one before it, and so on, each with its exact
conditional probability, so a segmentation is drawn with probability
proportional to the product of its pieces' weights.

No piece has a blank behind a letter or holds a line break, so the lattice
falls into independent units; the distinct units of a block of documents are
filtered together and all units are sampled together, as arrays.  Random numbers are a
hash of (seed, row key, unit, step): a row always gets the same segmentation.

Characters without a piece, and U+2581 itself, are written as byte pieces, so
decoding gives back the text exactly.

Defined results: null and empty texts have no ids; a null row key counts as
key 0; repeated rows get equal ids; columns other than the two read pass
through :func:`encode` (``ids`` is replaced).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_in_worker, mix64, workers_ready

MODEL = "piece_bpe_32k.model"
ALPHA = 1.0
BLANK = "▁"
_OWN_BLANK = "\ud800"           # stands for U+2581 in a text; never in valid UTF-8
_UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
BLOCK_CHARS = 1_500_000
_BASE = np.uint64(0x100000001B3)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Lattice:
    """Forward filtering and backward sampling over blocks of texts, as
    arrays: all distinct units of a block are filtered together."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        spelled = [sp.id_to_piece(i) for i in order]
        if max(map(len, spelled)) > 31 or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in spelled):
            raise ValueError("a piece is too long or crosses the units")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [b""] * n                       # what each id decodes to
        for i, p in zip(order, spelled):
            self.text[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.longest = max(map(len, spelled))
        weight = -alpha * np.log(np.arange(len(order)) + 1.0)
        self.weights = dict(zip(spelled, zip(order, weight)))
        self.rare = -alpha * float(np.log(len(order) + 1.0))     # log weight of one byte piece
        chars = sorted(set("".join(spelled)))
        of = dict(zip(chars, mix64(np.array([ord(c) for c in chars], np.uint64)).tolist()))
        hashes = [self._hashes(p, of) for p in spelled]
        keys = np.array([h[-1] for h in hashes], np.uint64)
        by = np.argsort(keys)
        self.keys, self.key_ids, self.key_weights = keys[by], np.array(order)[by], weight[by]
        self.slot = np.full(1 << 22, -1, np.int32)   # quick way to a key, right but for rare clashes
        self.slot[(self.keys >> np.uint64(42)).astype(np.int64)] = np.arange(len(order))
        self.longer = self._marked(np.array([x for h in hashes for x in h[:-1]], np.uint64))

    @staticmethod
    def _marked(keys: np.ndarray) -> np.ndarray:
        marks = np.zeros(1 << 22, bool)
        marks[(keys >> np.uint64(42)).astype(np.int64)] = True
        return marks

    @staticmethod
    def _hashes(piece: str, of: dict[str, int]) -> list[int]:
        """Hashes of all beginnings of a piece, the piece last."""
        out, h = [], 0
        for c in piece:
            h = (h * int(_BASE) + of[c]) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(text.replace(BLANK, _OWN_BLANK).replace(" ", BLANK))

    def _filter(self, distinct: list[str]):
        """Nodes and arcs of the lattices of all units: per arc (sorted by the
        node it ends in, long pieces first) the cumulative probability, the
        node it comes from and its id, or minus (code point + 1) for a
        character of several byte pieces; per node its first arc; per unit its first
        and last node."""
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        points = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(points)
        unit = np.repeat(np.arange(len(distinct)), sizes)
        starts = np.cumsum(sizes) - sizes
        room = (starts + sizes)[unit] - np.arange(n)              # characters left in the unit
        mixed = mix64(points.astype(np.uint64))
        h = np.zeros(n, np.uint64)                                 # of the next `size` characters
        at = np.arange(n)
        found = []
        for size in range(1, self.longest + 1):
            go = room[at] >= size
            at, h = at[go], h[go]
            h = h * _BASE + mixed[at + size - 1]
            mark = (h >> np.uint64(42)).astype(np.int64)
            k = self.slot[mark]
            hit = np.flatnonzero(k >= 0)
            k, own = k[hit], h[hit]
            clash = np.flatnonzero(self.keys[k] != own)
            k[clash] = np.minimum(np.searchsorted(self.keys, own[clash]), len(self.keys) - 1)
            ok = self.keys[k] == own
            frm, k = at[hit[ok]], k[ok]
            found.append((frm, frm + size, self.key_ids[k], self.key_weights[k]))
            if size == 1:                                          # characters written as bytes
                lone = np.ones(n, bool)
                lone[frm] = False
                lone = np.flatnonzero(lone)
                cp = np.where(points[lone] == ord(_OWN_BLANK), ord(BLANK), points[lone])
                width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
                one = np.asarray(self.byte)[np.minimum(cp, 127)]
                found.append((lone, lone + 1, np.where(cp < 128, one, -cp - 1), self.rare * width))
            more = self.longer[mark]
            at, h = at[more], h[more]
        frm, end, ids, w = (np.concatenate(x) for x in zip(*found))
        owner = unit[frm]
        frm, end = frm + owner, end + owner                        # a unit has one node more than characters
        by = np.argsort(end * 32 + (end - frm))
        frm, end, ids, w, owner = frm[by], end[by], ids[by], w[by], owner[by]
        first = starts + np.arange(len(distinct))
        place = end - first[owner]                                 # position of the end in its unit
        steps = np.argsort(place.astype(np.uint16) if place.max() < 65536 else place, kind="stable")
        bounds = np.searchsorted(place[steps], np.arange(1, int(place.max()) + 2))
        total = np.zeros(n + len(distinct))                        # log of the forward sums
        cum = np.empty(len(frm))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            a = steps[lo:hi]
            to = end[a]
            head = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            runs = np.diff(np.append(head, len(a)))
            x = total[frm[a]] + w[a]
            top = np.maximum.reduceat(x, head)
            e = np.exp(x - np.repeat(top, runs))
            s = np.add.reduceat(e, head)
            total[to[head]] = top + np.log(s)
            c = np.cumsum(e / np.repeat(s, runs))
            c -= np.repeat(np.concatenate(([0.0], c[head[1:] - 1])), runs)
            c[head + runs - 1] = 1.0
            cum[a] = c
        low = np.searchsorted(end, np.arange(n + len(distinct)))   # first arc into each node
        return cum, frm, ids, low, first, first + sizes

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in a row and the number of each text's;
        ``seeds`` are 64-bit row seeds."""
        cut = [self.units(t) for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        total = int(counts.sum())
        if not total:
            return np.empty(0, np.int64), counts
        distinct = list(set().union(*cut))
        number = dict(zip(distinct, range(len(distinct))))
        cum, back, ids, low, first, end = self._filter(distinct)
        at = np.fromiter((number[u] for c in cut for u in c), np.int64, total)
        place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mix64(np.repeat(seeds, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        who = np.argsort(at)                        # equal units side by side in memory
        at, seed = at[who], seed[who]
        node, stop = end[at], first[at]
        steps = []
        while len(who):                             # one piece back for every unfinished unit
            seed = mix64(seed + np.uint64(0xD1B54A32D192ED03))
            u = (seed >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            arc = low[node]
            on = np.flatnonzero(cum[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[cum[arc[on]] <= u[on]]
            steps.append((who, ids[arc]))
            node = back[arc]
            go = node > stop
            who, node, stop, seed = who[go], node[go], stop[go], seed[go]
        n_steps = np.zeros(total, np.int64)
        for w, _ in steps:
            n_steps[w] += 1
        ends = np.cumsum(n_steps)
        out = np.empty(int(ends[-1]), np.int64)
        for k, (w, piece) in enumerate(steps):
            out[ends[w] - 1 - k] = piece
        n_ids = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))])
        return self._spell(out, n_ids) if (out < 0).any() else (out, n_ids)

    def _spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters of several bytes."""
        at = np.flatnonzero(ids < 0)
        spelled = {x: [self.byte[b] for b in chr(-x - 1).encode()] for x in set(ids[at].tolist())}
        width = np.ones(len(ids), np.int64)
        width[at] = [len(spelled[x]) for x in ids[at].tolist()]
        begins = np.cumsum(width) - width
        out = np.repeat(ids, width)
        for x, to in spelled.items():
            here = begins[at[ids[at] == x]]
            for k, piece in enumerate(to):
                out[here + k] = piece
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
        return out, np.diff(ends)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode()


def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    """The worker's lattice of a model; it serves later tasks too."""
    return kept_in_worker(("lattice", path, alpha), lambda: Lattice(path, alpha))


def _seeds(keys: list, seed: int) -> np.ndarray:
    k = np.array([0 if x is None else x for x in keys], np.int64).view(np.uint64)
    return mix64(mix64(k) + np.uint64(seed))


def _blocks(texts: list) -> list[tuple[int, int]]:
    """Ranges of rows of about BLOCK_CHARS characters."""
    out, lo, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= BLOCK_CHARS:
            out.append((lo, i + 1))
            lo, n = i + 1, 0
    return out + [(lo, len(texts))] * (lo < len(texts))


def encode(docs: DataFrame, seed: int = 0, path: str | None = None, key: str = "doc_id",
           text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``ids``, a sampled segmentation of every whole text."""
    workers_ready(docs.sparkSession)
    base, path = docs.drop("ids"), path or model_path()
    schema = T.StructType(base.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        grid = lattice(path, alpha)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            seeds = _seeds(b.column(b.schema.get_field_index(key)).to_pylist(), seed)
            for lo, hi in _blocks(texts):
                ids, counts = grid.sample([t or "" for t in texts[lo:hi]], seeds[lo:hi])
                part = b.slice(lo, hi - lo)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(part.columns) + [made], names=list(b.schema.names) + ["ids"])

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that ``ids`` spell."""
    workers_ready(encoded.sparkSession)
    base, path = encoded.drop("decoded"), path or model_path()
    schema = T.StructType(base.schema.fields + [T.StructField("decoded", T.StringType())])

    def run(batches):
        grid = lattice(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            for lo in range(0, len(ids), 256):
                part = b.slice(lo, 256)
                out = [grid.decode(x.values.to_pylist()) if x.is_valid else None for x in ids.slice(lo, 256)]
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(out, pa.string())],
                                                 names=list(b.schema.names) + ["decoded"])

    return base.mapInArrow(run, schema)


def digest(docs: DataFrame, seed: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of every document: encoded,
    decoded and compared in one pass; the crc is over unsigned 32-bit
    little-endian ids."""
    workers_ready(docs.sparkSession)
    path = path or model_path()

    def run(batches):
        grid = lattice(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            seeds = _seeds(b.column("doc_id").to_pylist(), seed)
            for lo, hi in _blocks(texts):
                ids, counts = grid.sample(texts[lo:hi], seeds[lo:hi])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                flat, begins = ids.tolist(), (ends - counts).tolist()
                crc, same = [], []
                for t, a, e in zip(texts[lo:hi], begins, ends.tolist()):
                    crc.append(zlib.crc32(raw[4 * a:4 * e]))
                    same.append(grid.decode(flat[a:e]) == t)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)],
                    names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean")
