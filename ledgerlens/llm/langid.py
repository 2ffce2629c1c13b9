"""Language identification by string kernels (operator 1).

Blended-spectrum presence kernel: a text is the set of its character 1-, 2-
and 3-grams (letters lower-cased, everything else one blank symbol), and
``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``.  A Nystroem map over
landmark texts turns the kernel into features, one-versus-rest ridge
regression gives one weight vector per language, and both fold into one
matrix, so that a batch of documents is scored by two matrix products:
presence (docs x n-grams) times landmarks, then times weights.

N-grams are exact numbers made of their code points, so every script keeps
its own; the columns of the matrix are the n-grams of the landmarks.

Fit on a bounded sample of different texts: at most ``TRAIN_PER_LANG`` a
language, and ``LANDMARKS_PER_LANG`` landmarks a language, fewer each where
there are more than ``LANDMARKS`` in all (parameters).  A language with fewer
texts is learned from all of them, however often rows repeat.  Whole texts are
read in fitting and in scoring.

Defined results: null text or a text without letters gives ``und`` and score
0; repeated rows are scored alike; with no labelled row every document is
``und``; only ``doc_id``, ``text`` and (in fitting) ``lang`` are read, other
columns pass through :func:`identify` untouched.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, workers_ready

TRAIN_PER_LANG = 600        # training texts per language at most
LANDMARKS_PER_LANG = 40     # landmark texts per language at most
LANDMARKS = 400             # landmark texts of all languages together (one each at least)
RIDGE = 1e-2
SHARPNESS = 6.0             # softmax scale turning ridge outputs into a 0..1 score
BATCH = 128                 # documents per matrix product

_BITS = np.int64(21)         # a code point and the blank need 21 bits
_LETTERS: np.ndarray | None = None


def _lower_letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, 0 for the rest."""
    global _LETTERS
    if _LETTERS is None:
        t = np.zeros(sys.maxunicode + 1, np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha() and unicodedata.category(ch)[0] == "L":
                t[cp] = ord(ch.lower()[0])
        _LETTERS = t
    return _LETTERS


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters of a text with 0 between the runs of letters."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return _lower_letters()[cps]


def grams(lett: np.ndarray) -> np.ndarray:
    """The different n-grams of a text, sorted: one to three symbols (code
    point + 1, 1 for a blank) as the digits of one number."""
    x = np.concatenate(([0], lett, [0]))
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))].astype(np.int64) + 1       # one blank per gap
    two = (x[:-1] << _BITS) | x[1:]
    return np.unique(np.concatenate((x[x > 1], two, (two[:-1] << _BITS) | x[2:])))


class Scorer:
    """Kernel rows against the landmarks, in blocks of documents."""

    def __init__(self, vocab: np.ndarray, marks: np.ndarray, sizes: np.ndarray):
        self.vocab, self.marks, self.sizes = vocab, marks, sizes

    def kernel(self, block: list[np.ndarray]) -> np.ndarray:
        seen = np.zeros((len(block), len(self.vocab)), np.float32)
        n = np.empty(len(block), np.float32)
        for i, lett in enumerate(block):
            g = grams(lett)
            n[i] = len(g)
            at = np.searchsorted(self.vocab, g)
            at[at == len(self.vocab)] = 0
            seen[i, at[self.vocab[at] == g]] = 1.0
        hits = seen @ self.marks.T
        return hits / np.sqrt(np.maximum(n, 1)[:, None] * self.sizes[None, :])


def _per_lang_sample(docs: DataFrame, train: Column, per_lang: int, salt: int, at_most: int | None = None) -> DataFrame:
    """(lang, text): at most ``per_lang`` different texts of each language
    (``at_most`` in all, one each at least), those with the least hashes.

    Counts of different texts thin the rows first, copies of a text meet in a
    pre-aggregated group, and the exact cut sees little more than it keeps."""
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(salt), "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text").limit(0)
    if at_most is not None:
        per_lang = max(1, min(per_lang, at_most // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items())
                           for x in (k, min(1.0, (1.5 * per_lang + 20) / max(1, n)))])
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    texts = labelled.where(u < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    least = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    return texts.withColumn("n", F.row_number().over(least)).where(F.col("n") <= per_lang).select("lang", "text")


def fit(docs: DataFrame, train: Column, per_lang: int = TRAIN_PER_LANG,
        landmarks_per_lang: int = LANDMARKS_PER_LANG) -> dict | None:
    """Learn the model from rows where ``train`` holds; None without any."""
    spark = docs.sparkSession
    workers_ready(spark)
    marks = _per_lang_sample(docs, train, landmarks_per_lang, 11, LANDMARKS).collect()
    lett = sorted(((r["lang"], letters(r["text"])) for r in marks), key=lambda m: (m[0], m[1].tobytes()))
    rows = [(g, grams(x)) for g, x in lett if x.any()]
    if not rows:
        return None
    vocab = np.unique(np.concatenate([x for _, x in rows]))
    dense = np.zeros((len(rows), len(vocab)), np.float32)
    for i, (_, x) in enumerate(rows):
        dense[i, np.searchsorted(vocab, x)] = 1.0
    sizes = np.array([len(x) for _, x in rows], np.float32)
    langs = sorted({g for g, _ in rows})
    model = {"vocab": vocab, "marks": dense, "sizes": sizes, "langs": langs}
    k_mm = (dense @ dense.T) / np.sqrt(sizes[:, None] * sizes[None, :])
    values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])          # landmarks -> Nystroem features
    shared = spark.sparkContext.broadcast(model)              # bounded by the landmark sample

    def gram(batches):
        m = shared.value
        scorer = Scorer(m["vocab"], m["marks"], m["sizes"])
        d = root.shape[1] + 1
        xx, xy = np.zeros((d, d)), np.zeros((d, len(m["langs"])))
        for b in sliced(batches):
            pairs = [(g, letters(t)) for g, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist())
                     if g in m["langs"]]
            pairs = [(g, x) for g, x in pairs if x.any()]
            for i in range(0, len(pairs), BATCH):
                part = pairs[i:i + BATCH]
                f = scorer.kernel([x for _, x in part]).astype(np.float64) @ root
                f = np.hstack([f, np.ones((len(f), 1))])
                y = np.array([[1.0 if g == h else -1.0 for h in m["langs"]] for g, _ in part])
                xx += f.T @ f
                xy += f.T @ y
        yield pa.RecordBatch.from_pydict({"xx": [xx.tobytes()], "xy": [xy.tobytes()]})

    d = root.shape[1] + 1
    xx, xy = np.zeros((d, d)), np.zeros((d, len(langs)))
    sample = _per_lang_sample(docs, train, per_lang, 13)
    for r in sample.mapInArrow(gram, "xx binary, xy binary").toLocalIterator():
        xx += np.frombuffer(r["xx"]).reshape(xx.shape)
        xy += np.frombuffer(r["xy"]).reshape(xy.shape)
    n = max(1.0, xx[-1, -1])
    w = np.linalg.solve(xx / n + RIDGE * np.eye(d) / np.sqrt(n), xy / n)
    model |= {"weights": (root @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32)}
    return model


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are
    replaced)."""
    spark = docs.sparkSession
    base = docs.drop("lang_pred", "score")
    if model is None:
        return base.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    workers_ready(spark)
    shared = spark.sparkContext.broadcast(model)              # bounded by the landmark sample
    schema = T.StructType(base.schema.fields + [T.StructField("lang_pred", T.StringType()),
                                                T.StructField("score", T.DoubleType())])

    def predict(batches):
        m = shared.value
        scorer = Scorer(m["vocab"], m["marks"], m["sizes"])
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index("text"))
            names, scores = [], []
            for i in range(0, len(texts), BATCH):
                block = [letters(t) for t in texts.slice(i, BATCH).to_pylist()]
                out = scorer.kernel(block) @ m["weights"] + m["bias"]
                e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
                p = e.max(axis=1) / e.sum(axis=1)
                best = out.argmax(axis=1)
                for x, j, s in zip(block, best, p):
                    known = bool(x.any())
                    names.append(m["langs"][j] if known else "und")
                    scores.append(float(s) if known else 0.0)
            cols = list(b.columns) + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names) + ["lang_pred", "score"])

    return base.mapInArrow(predict, schema)
