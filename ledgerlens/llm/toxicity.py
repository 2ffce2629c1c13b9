"""Toxicity scores by a fuzzy lexicon (operator 3).

The lexicon is learned from labelled texts: words and word stems whose rate in
toxic texts is many times that in clean ones.  Evidence for a term is counted
over distinct neighbour pairs, so that copies of one toxic text do not make
its ordinary words look toxic.  A trie holds the terms; the Levenshtein
automaton of every term is run over the whole trie at once (states are sets
of (trie node, edits), determinised as words are read), which finds exact,
misspelled and inflected forms in one pass over a word, a misspelled stem or
first letter among them.  Words seen in clean training texts are never taken
for misspellings, nor what these words begin with for a misspelled stem.  Each hit is weighed by its
context window: quotation marks and reporting words make it count less,
second-person words more.  A logistic model over the document's summed
weights gives the score.

``TRAIN_ROWS`` bounds the labelled rows the lexicon and the logistic model are
fitted on (a parameter); every text is scored whole.

Defined results: null and empty texts, and any text when nothing could be
learned, get the model's score for no hits; repeated rows score alike; labels
that are null or other than 0/1 are ignored; columns ``score`` and
``predicted`` of the input are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table, sliced, workers_ready

TRAIN_ROWS = 8000           # labelled rows to learn from at most
THRESHOLD = 0.7
MIN_LOG_ODDS = 2.5
STATES = 50_000             # determinised states a scanner holds before it starts anew
STEMS = (4, 8)              # stem lengths tried
WINDOW = 6                  # context words on each side

TOKEN = r"[^\W_]+(?:[@$*][^\W_]+)*"
JVM_TOKEN = r"[\p{L}\p{N}]+(?:[@$*][\p{L}\p{N}]+)*"

# Context words (general vocabulary of the four languages).
REPORTING = frozenset("called calling said says word words term terms quote quoted wrote named "
                      "dit mot sagte wort dijo palabra".split())
SECOND_PERSON = frozenset("you your youre ur du dich dein tu toi vous usted eres".split())
QUOTES = "\"“”«»„"


def edits_allowed(term: str, stem: bool) -> int:
    return 0 if stem else 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0


class FuzzyTrie:
    """Levenshtein automata of all terms, run together over their trie.

    ``match(word)`` is the least number of edits to a term, or None.  Stems
    match any word they begin.  With ``strict`` the first letter must agree
    and stems must be exact; without, a stem may have the edits of a whole
    word of its length, and the first letter may be edited as any other.
    """

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str] = frozenset(), strict: bool = True):
        self.kids: list[dict[str, int]] = [{}]
        self.budget, self.ends, self.stem = [0], [-1], [-1]      # edits; -1: no term, no stem ends here
        self.clean, self.strict = clean, strict
        for term, is_stem in terms:
            k, node = edits_allowed(term, is_stem and strict), 0
            if not strict:
                self.budget[0] = max(self.budget[0], k)
            for ch in term:
                nxt = self.kids[node].get(ch)
                if nxt is None:
                    nxt = self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.budget.append(0)
                    self.ends.append(-1)
                    self.stem.append(-1)
                node = nxt
                self.budget[node] = max(self.budget[node], k)
            self.ends[node] = max(self.ends[node], k)
            if is_stem:
                self.stem[node] = max(self.stem[node], k)
        self.forget()
        self.clean_begins: frozenset[str] = frozenset()
        self.clean_begins = frozenset(w[:i] for w in clean for i, _ in self._stems(w))

    def forget(self) -> None:
        """Drop the determinised states; words make them again."""
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._accept: list[int] = []          # edits when the word ends here, or -1
        self._begun: list[int] = []           # edits of a stem that ends here, or -1
        self._start = self._state({0: 0}, not self.strict)

    def _state(self, best: dict[int, int], start: bool = True) -> int:
        todo = list(best.items()) if start else []
        while todo:                            # skipping letters of the term
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e + 1 <= self.budget[kid] and e + 1 < best.get(kid, 9):
                    best[kid] = e + 1
                    todo.append((kid, e + 1))
        key = frozenset(best.items())
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            self._accept.append(min((e for n, e in key if e <= self.ends[n]), default=-1))
            self._begun.append(min((e for n, e in key if e <= self.stem[n]), default=-1))
        return self._ids[key]

    @property
    def states(self) -> int:
        return len(self._sets)

    def _step(self, state: int, ch: str) -> int:
        best: dict[int, int] = {}
        for node, e in self._sets[state]:
            for c, kid in self.kids[node].items():
                cost = e if c == ch else e + 1
                if (node or c == ch or not self.strict) and cost <= self.budget[kid] and cost < best.get(kid, 9):
                    best[kid] = cost
            if (node or not self.strict) and e + 1 <= self.budget[node] and e + 1 < best.get(node, 9):
                best[node] = e + 1
        to = self._state(best) if best else -1
        self._steps[state][ch] = to
        return to

    def _stems(self, word: str):
        """(letters read, edits) wherever a misspelled stem begins the word."""
        state = self._start
        for i, ch in enumerate(word, 1):
            to = self._steps[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return
            if self._begun[state] > 0:
                yield i, self._begun[state]

    def match(self, word: str) -> int | None:
        state, steps, begun = self._start, self._steps, -1
        for i, ch in enumerate(word, 1):
            to = steps[state].get(ch)
            if to is None:
                to = self._step(state, ch)
            if to < 0:
                e = begun
                break
            e = self._begun[to]
            if e == 0:
                return 0
            if e > 0 and (begun < 0 or e < begun) and word[:i] not in self.clean_begins:
                begun = e
            state = to
        else:
            e = self._accept[state]
            if e < 0 or 0 < begun < e:
                e = begun
        return None if e < 0 or (e > 0 and word in self.clean) else e


class Scanner:
    """Hits of a lexicon in texts, weighed by context."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str], limit: int = 150_000):
        self.trie = FuzzyTrie(terms, clean, strict=False)
        self.token = re.compile(TOKEN)
        self.known: set[str] = set()
        self.hits: dict[str, int] = {}
        self.limit = limit

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = self.token.findall(low)
        own = set(words)
        if len(self.known) > self.limit:
            self.known.clear()
            self.hits.clear()
        if self.trie.states > STATES:
            self.trie.forget()
        for w in own.difference(self.known):
            e = self.trie.match(w)
            if e is not None:
                self.hits[w] = e
        self.known |= own
        if not any(w in self.hits for w in own):
            return [0.0, 0.0]
        total, kinds = 0.0, set()
        spans = [(m.start(), m.end()) for m in self.token.finditer(low)]
        for i, w in enumerate(words):
            if w in self.hits:
                total += (1.0, 0.7, 0.5)[self.hits[w]] * self._context(low, words, spans, i)
                kinds.add(w)
        return [math.log1p(total), math.log1p(total / math.sqrt(max(1, len(words)) / 100))]

    @staticmethod
    def _context(low: str, words: list[str], spans: list[tuple[int, int]], i: int) -> float:
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = low[spans[a][0]:spans[i][0]], low[spans[i][1]:spans[b - 1][1]]
        near = set(words[a:b])
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        weight = 0.4 if quoted or near & REPORTING else 1.0
        return weight * (1.3 if near & SECOND_PERSON and not quoted else 1.0)


def _sample(docs: DataFrame, labels: DataFrame, train: Column, rows: int) -> DataFrame:
    """At most ``rows`` different labelled (id, text), by a hash of the id and
    then, should an id hold many texts, of the text; written once."""
    pool = (labels.where(F.col("toxic").isin(0, 1) & train)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = pool.count()
    u = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = pool.where(u < min(1.0, rows / max(1, n)))
    each = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "doc_id")           # bounded: about `rows` small rows
            .groupBy("doc_id", "toxic", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")))
    least = each.orderBy(F.xxhash64(F.lit(17), "doc_id", "h"), "doc_id", "h").limit(rows)
    return shared_table(least.select("doc_id", "text", "toxic"), "toxic-sample")


def learn_terms(sample: DataFrame, min_log_odds: float = MIN_LOG_ODDS,
                most: int | None = None) -> list[tuple[str, bool]]:
    """(term, is_stem) pairs that mark toxic texts of the sample: stems and
    words outside them (the ``most`` frequent, all by default), and every
    accepted word behind one of these stems."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return []
    support = max(6, math.ceil(0.01 * n_pos))
    words = sample.select("doc_id", "toxic", F.expr(
        f"regexp_extract_all(lower(text), r'{JVM_TOKEN}', 0)").alias("w"))
    pos = (words.where("toxic = 1")
           .select(F.explode(F.expr("""transform(w, (x, i) ->
               struct(x AS term, xxhash64(get(w, i - 1), get(w, i + 1)) AS near))""")).alias("s"))
           .select("s.*").distinct().groupBy("term").agg(F.count("*").alias("pos")))
    docs_with = (words.select("toxic", F.explode(F.array_distinct("w")).alias("term"))
                 .groupBy("term").agg(F.sum("toxic").alias("pos_docs"),
                                      F.sum(1 - F.col("toxic")).alias("neg_docs")))
    lo, hi = STEMS
    joined = docs_with.join(pos, "term", "left").fillna(0, ["pos"])
    forms = F.expr(f"""concat(array(struct(term AS form, false AS stem)),
        transform(filter(sequence({lo}, {hi}), k -> k <= length(term)),
                  k -> struct(substring(term, 1, k) AS form, true AS stem)))""")
    a = (F.least(F.col("pos"), F.col("pos_docs")) + 0.5) / (n_pos + 1.0)
    b = (F.col("neg_docs") + 0.5) / (n_neg + 1.0)
    found = (joined.withColumn("f", F.explode(forms)).groupBy("f.form", "f.stem")
             .agg(F.sum("pos").alias("pos"), F.sum("pos_docs").alias("pos_docs"),
                  F.sum("neg_docs").alias("neg_docs"))
             .where((F.col("pos") >= support) & (F.col("pos_docs") >= support)
                    & (F.length("form") >= 3) & (F.log(a / b) >= min_log_odds))
             .collect())                                    # accepted forms of the bounded sample
    stems = {r["form"]: r["pos"] for r in found if r["stem"]}
    whole = {r["form"]: r["pos"] for r in found if not r["stem"]}
    terms: dict[tuple[str, bool], int] = {}
    for s in sorted(stems, key=len):
        if any(s[:k] in stems for k in range(lo, len(s))):
            continue                                        # inside a shorter accepted stem
        inside = [(t, False, n) for t, n in whole.items() if t.startswith(s)]
        inside += [(t, True, n) for t, n in stems.items() if t.startswith(s)]
        # the most specific form that keeps the stem's evidence; whole words first
        t, is_stem, n = max(((t, k, n) for t, k, n in inside if n >= 0.9 * stems[s]),
                            key=lambda x: (not x[1], len(x[0])))
        terms[t, is_stem] = n
    for t, n in whole.items():
        if not any((t[:k], True) in terms for k in range(lo, len(t) + 1)):
            terms[t, False] = n
    kept = sorted(terms, key=lambda t: (-terms[t], t))[:most]
    behind = [t for t in sorted(whole) if (t, False) not in terms
              and any((t[:k], True) in kept for k in range(lo, len(t) + 1))]
    return kept + [(t, False) for t in behind]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted evenly."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n_pos = max(1, y.sum())
    sw = np.where(y == 1, 0.5 / n_pos, 0.5 / max(1, len(y) - n_pos))
    pen = np.diag([ridge / 100] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (sw * (p - y)) + pen @ w
        h = (x * (sw * p * (1 - p))[:, None]).T @ x + pen + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> dict:
    """Lexicon and logistic weights from labelled rows where ``train`` holds."""
    spark = docs.sparkSession
    workers_ready(spark)
    sample = _sample(docs, labels, train, rows)
    terms = learn_terms(sample)
    if not terms:
        return {"terms": [], "clean": frozenset(), "weights": [0.0, 0.0, -3.0]}

    def near_words(batches):
        trie = FuzzyTrie(terms, strict=False)
        token, seen = re.compile(TOKEN), Counter()
        for b in sliced(batches):
            for text in b.column("text").to_pylist():
                seen.update(set(token.findall(text.lower())))
        near = sorted(w for w in seen if trie.match(w))
        yield pa.RecordBatch.from_pydict({"w": pa.array(near, pa.string()),
                                          "n": pa.array([seen[w] for w in near], pa.int64())})

    counts = {r["w"]: r["n"] for r in sample.where("toxic = 0").select("text")
              .mapInArrow(near_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    clean = frozenset(counts)
    elsewhere = frozenset(w for w, n in counts.items() if n > 1)

    def observe(batches):
        # a clean text is judged by the words of the other clean texts, as an unseen one is
        scans = (Scanner(terms, elsewhere), Scanner(terms, clean))
        for b in sliced(batches):
            f = [scans[y].features(t) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.list_(pa.float64())), "y": b.column("toxic")})

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")) \
        .mapInArrow(observe, "f array<double>, y int").collect()     # bounded by `rows`
    x = np.array([r["f"] for r in seen])
    y = np.array([r["y"] for r in seen], float)
    return {"terms": terms, "clean": clean, "weights": _logistic(x, y).tolist()}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0..1) and ``predicted`` (score >= threshold)."""
    spark = docs.sparkSession
    workers_ready(spark)
    base = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)            # bounded by the sample
    schema = T.StructType(base.schema.fields + [T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        scan, w = Scanner(m["terms"], m["clean"]), m["weights"]
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            out = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * c for a, c in zip(w, scan.features(t))) + w[-1]))))
                   for t in texts]
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(out, pa.float64())],
                                             names=list(b.schema.names) + ["score"])

    return base.mapInArrow(run, schema).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
