"""The learned operators on rows they have not seen, against plain versions,
and their samples; fingerprints computed again in Python."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprint, langid, toxicity
from ledgerlens.llm.common import crc_bucket, read_table
from tests.conftest import SF_SMALL

SF_MORE = SF_SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def more(spark):
    return read_table(spark, SF_MORE, "documents").cache()


def test_languages_of_held_out_rows(more):
    held = crc_bucket(F.col("doc_id"), 4) == 2
    out = langid.identify(more.where(held), langid.fit(more, ~held)).where("lang IS NOT NULL AND lang_pred <> 'und'")
    n = out.count()
    assert n > 100 and out.where("lang = lang_pred").count() >= 0.97 * n


def test_eight_scripts_are_told_apart(spark):
    rng = np.random.default_rng(3)
    alphabets = {f"s{k}": [chr(lo + i) for i in range(n)] for k, (lo, n) in enumerate(
        ((0x4E00, 300), (0x5200, 300), (0xAC00, 300), (0xB000, 300), (0x3041, 80), (0x1200, 200), (0x0410, 32), (0x03B1, 24)))}

    def text(letters):
        return " ".join("".join(rng.choice(letters, int(rng.integers(1, 7)))) for _ in range(40))
    rows = [(i * 8 + k, text(a), lang) for k, (lang, a) in enumerate(alphabets.items()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df.where("doc_id >= 320"), langid.fit(df, F.col("doc_id") < 320))
    right = {r["lang"]: r["c"] for r in out.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("c")).collect()}
    assert len(right) == 8 and min(right.values()) > 0.95


def test_kernel_ridge_equals_the_plain_one(spark):
    words = {"x": "the of and to in is that it was for", "y": "der die und das ist nicht ein zu den mit"}
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(words[g].split(), 12)), g) for i, g in enumerate("xy" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), per_lang=30, landmarks_per_lang=30)

    def plain_grams(t):
        t = " " + t.lower() + " "
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}
    sets = [plain_grams(t) for _, t, _ in rows]
    assert all(len(langid.grams(langid.letters(t))) == len(s) for (_, t, _), s in zip(rows, sets))
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # all texts are landmarks: Nystroem features give back the kernel, ridge on them is kernel ridge
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    f = np.hstack([vectors[:, keep] * np.sqrt(values[keep]), np.ones((60, 1))])
    y = np.array([[1.0 if g == h else -1.0 for h in "xy"] for _, _, g in rows])
    w = np.linalg.solve(f.T @ f / 60 + langid.RIDGE * np.eye(f.shape[1]) / np.sqrt(60), f.T @ y / 60)
    scorer = langid.Scorer(model["vocab"], model["marks"], model["sizes"])
    got = scorer.kernel([langid.letters(t) for _, t, _ in rows]) @ model["weights"] + model["bias"]
    assert np.abs(got - f @ w).max() < 5e-3


def test_repeated_rows_leave_a_language_its_sample(spark):
    rows = [(None, "μόνο ένα κείμενο εδώ", "el")] * 3000 + [(i, f"plain text number {i} here", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._per_lang_sample(df, F.lit(True), 50, 13).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample} == {"el": 1, "en": 50}
    assert langid.identify(df.limit(1), langid.fit(df, F.lit(True))).first()["lang_pred"] == "el"
    few = langid._per_lang_sample(df, F.lit(True), 50, 13, at_most=8).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in few} == {"el": 1, "en": 4}


def test_toxic_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(1, "text 0")] * 500 + [(i, "x") for i in range(2, 50)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 50)], "doc_id long, quality int, toxic int")
    sample = toxicity._sample(docs, labels, F.lit(True), 100)
    assert sample.count() == 100 and sample.distinct().count() == 100
    assert toxicity._sample(docs, labels, F.lit(True), 10_000).count() == 3048


def test_lexicons_are_not_cut(spark):
    rng = np.random.default_rng(5)
    bad = sorted({"".join(rng.choice(list("bdfgklmnprstvz"), 9)) for _ in range(700)})
    rows = [(i, 1, " ".join(rng.permutation(bad))) for i in range(12)] + [(100 + i, 0, f"a{i} plain b{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    trie = toxicity.FuzzyTrie(toxicity.learn_terms(df), strict=False)
    assert len(bad) > 650 and all(trie.match(w) == 0 for w in bad)
    assert len(toxicity.learn_terms(df, most=20)) < len(toxicity.learn_terms(df))


def test_toxicity_of_held_out_rows(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    held = crc_bucket(F.col("doc_id"), 3) == 1
    out = toxicity.score(docs.where(held), toxicity.fit(docs, labels, ~held)).join(labels, "doc_id").where("toxic IN (0, 1)")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"),
                F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false"), F.count_if(F.col("toxic") == 1).alias("n")).first()
    assert r["n"] > 100 and r["found"] > 0.85 and r["false"] < 0.01


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_production_trie_equals_edit_distance():
    terms = [("moron", False), ("pathetic", False), ("idiotic", True), ("scumbags", True), ("bad", False)]
    trie = toxicity.FuzzyTrie(terms, strict=False)
    rng = np.random.default_rng(0)
    words = set()
    for t, _ in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(int(rng.integers(0, 4))):
                i, what = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[i:i + 1] = [] if what == 0 and len(w) > 1 else [str(rng.choice(list("abotx")))] + ([w[i]] if what == 1 else [])
            words.add("".join(w) + str(rng.choice(["", "s", "ness"])))

    def plain(w):
        best = []
        for t, stem in terms:
            k = toxicity.edits_allowed(t, False)
            # a stem matches what begins with it, misspelled or not
            e = min(edits(w[:i], t) for i in range(1, len(w) + 1)) if stem else edits(w, t)
            best += [e] if e <= k else []
        return min(best, default=None)
    for w in sorted(words):
        if any(s and edits(w[:i], t) == 0 for t, s in terms for i in range(1, len(w) + 1)):
            assert trie.match(w) == 0, w
        else:
            assert (trie.match(w) is None) == (plain(w) is None), w
    n = trie.states
    trie.forget()
    assert trie.states < n and trie.match("mor0n") == 1


def plain_sketch(text, k=fingerprint.K):
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h                                      # noqa: E731
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not words:
        return []
    if len(words) < 5:
        return [signed(xxhash.xxh64_intdigest(" ".join(str(signed(h)) for h in hashes).encode(), 42))]
    out = set()
    for i in range(len(words) - 4):
        seed = 42
        for h in hashes[i:i + 5]:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return sorted(out)[:k]


def plain_likeness(a, b, k=fingerprint.K):
    every = sorted(set(a) | set(b))
    low = every if len(a) < k and len(b) < k else every[:k]
    return 1.0 if not low else len(set(a) & set(b) & set(low)) / len(low)


def test_fingerprints_computed_again(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "Cd", "ef", "gh", "é"], int(rng.integers(0, 300)))) for _ in range(40)] + [None, "", "One two", "x " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r for r in fingerprint.digest(fingerprint.edited_pairs(df)).collect()}
    assert len(out) == len(texts)
    said = lambda s: "".join(f"{h & (2 ** 64 - 1):016X}" for h in s)                             # noqa: E731
    for i, t in enumerate(texts):
        x, y = t or "", texts[(i + 1) % len(texts)] or ""
        c = len(x) // 4
        mine, edited, after = plain_sketch(x), plain_sketch(x[:len(x) - c] + y[:c]), plain_sketch(y)
        assert out[i]["fingerprint"] == said(mine) and out[i]["edited_fingerprint"] == said(edited), i
        assert abs(out[i]["near_edited"] - plain_likeness(mine, edited)) < 1e-12
        assert abs(out[i]["near_next"] - plain_likeness(mine, after)) < 1e-12
