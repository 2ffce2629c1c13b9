"""Secret scans by a trigram inverted index (operator 2).

Every rule is a regular expression.  From its parse tree a Boolean query over
lower-cased trigrams is derived: a disjunction of trigram sets, one of which
every match must contain.  The index holds postings (trigram, document) for
the trigrams that some rule asks for; counting a document's postings per set
intersects them, and only the resulting candidates are verified by the
expression.  A rule without mandatory trigrams is run over every text.

Built from DataFrame functions throughout.  Offsets are code points, end
exclusive.

Defined results: null text counts as empty and has no spans; repeated rows
are scanned alike; an empty table gives an empty result; columns of the input
other than ``text`` pass through (``secret_spans`` is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .spans import find_spans, listed, no_spans

BROADCAST_ROWS = 1_000_000      # candidate keys broadcast at most (about 40 bytes each)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0              # part that must have `least` characters
    least: int = 0


# Fixed values of the base rules, then added kinds in publicly documented formats.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED

_ANY = None                     # no mandatory trigram
_MOST_STRINGS, _MOST_CLASS = 32, 6


def _both(a, b):
    if a is _ANY or b is _ANY:
        return b if a is _ANY else a
    return sorted({x | y for x in a for y in b}, key=sorted)


def _either(a, b):
    return _ANY if a is _ANY or b is _ANY else sorted({*a, *b}, key=sorted)


def _grams(strings: set[str]):
    sets = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
    return _ANY if not all(sets) else sorted(set(sets), key=sorted)


def _walk(nodes):
    """(exact strings or None, query) of a sequence of parse nodes."""
    exact, query, whole = {""}, _ANY, True

    def flush():
        nonlocal exact, query, whole
        query, exact, whole = _both(query, _grams(exact)), {""}, False

    for op, arg in nodes:
        name, strings, own = str(op), None, _ANY
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= _MOST_CLASS:
            strings = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            strings, own = _walk(arg[-1])
        elif name == "BRANCH":
            found = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            if strings is None:
                own = found[0][1] if found[0][0] is None else _both(found[0][1], _grams(found[0][0]))
                for s, q in found[1:]:
                    own = _either(own, q if s is None else _both(q, _grams(s)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            inner, inside = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif low == high == 1:
                strings, own = inner, inside
            elif low >= 1:
                own = inside if inner is None else _grams(inner)
        if strings is not None and len(exact) * len(strings) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            query = _both(query, own)
        else:
            flush()
            query = _both(query, own if strings is None else _both(own, _grams(strings)))
    return (exact, query) if whole else (None, _both(query, _grams(exact)))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams; every match of ``regex`` contains all of
    at least one set.  None: no trigram is mandatory."""
    exact, query = _walk(regex_tree.parse(regex))
    query = query if exact is None else _both(query, _grams(exact))
    return query and [s for s in query if not any(o < s for o in query)]


def build_postings(docs: DataFrame, trigrams: list[str], key: str, text: str = "text") -> DataFrame:
    """Inverted index (trigram, key) over whole texts, for these trigrams."""
    low = docs.select(key, F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in trigrams]))
    return low.select(key, F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]], key: str) -> DataFrame:
    """(key, kinds): documents whose postings satisfy the query of a kind."""
    sets = [(k, i, s) for k, q in sorted(queries.items()) for i, s in enumerate(q)]
    trigrams = sorted(set().union(*(s for _, _, s in sets)))
    wanted = F.create_map(*[x for g in trigrams for x in (F.lit(g), F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(len(s)).alias("need"))
          for k, i, s in sets if g in s]))])
    posts = build_postings(docs, trigrams, key)
    return (posts.select(key, "trigram", F.explode(wanted[F.col("trigram")]).alias("c"))
            .groupBy(key, "c").agg(F.count_distinct("trigram").alias("held"))
            .where(F.col("held") == F.col("c.need"))
            .groupBy(key).agg(F.collect_set("c.kind").alias("kinds")))     # at most one entry a rule


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["part"]) >= least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (kind, rank, start, end, text)."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"]
    base = docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    # equal keys of different rows only add candidates, and those are verified
    base = base.withColumn("_key", F.xxhash64("_text"))
    kinds = F.lit(None).cast("array<string>")
    if indexed:
        keyed = base.select("_key", F.col("_text").alias("text"))
        found = shared_table(candidates(keyed, indexed, "_key"), "secret-candidates")
        side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        base, kinds = base.join(side, "_key", "left"), F.col("kinds")
    t = F.col("_text")
    parts = []
    for rank, r in enumerate(rules):
        guard = F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), r.kind) \
            if r.kind in indexed else None
        s = find_spans(t, r.kind, rank, r.regex, r.group, guard=guard)
        parts.append(_long_enough(s, r.least) if r.least else s)
    return base.select("row.*", (F.concat(*parts) if parts else no_spans()).alias("secret_spans"))


def of_kind(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans as text."""
    s = F.col("secret_spans")
    order = ["start", "rank"]
    return scanned.select(
        "doc_id", *[F.size(of_kind(s, (r.kind,))).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(of_kind(s, tuple(r.kind for r in BASE)), order), 256).alias("base_sha256"),
        listed(s, order).alias("spans"))
