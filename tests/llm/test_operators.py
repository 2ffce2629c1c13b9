"""Each operator against a brute-force version or an exact round trip, on
frames with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (fingerprint, hamming, langid, neardup, packing, pieces, pii, queries, secrets,
                            token_index, tokens, toxicity)
from ledgerlens.llm.common import crc_bucket, read_table, shared_path
from tests.conftest import SF_SMALL

ODD = ["", None, "x", "AKIA" + "A" * 16 + " token=pass password=abcdef1 secret=token = abcdefgh",
       "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 4111 1111 1111 1111 4111111111111111 12 "
       "+1 (22) 333-4444 é𝒳 a@b.co", "DE89 3704 0044 0532 0130 00 ssn 123-45-6789 and x",
       "APIKEY: 'abcdefg' Token\"=\"zzzzzzz ghp_" + "a" * 40, "0" * 30 + "@", "q" * 9000 + " " * 40,
       "a  b\n\n c\x1cd é▁ ▁x 漢 𝒳 \t\r\n", "one two three four five six seven"] + \
      ["one two three four five six seven"] * 3 + [" ".join(f"w{i % 997}" for i in range(20_000))]
SCHEMA = "doc_id long, text string, lang string, score int, spans int, n_chars long, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(10 ** 9 + i // 2, t, None, 1, 2, None, 3) for i, t in enumerate(ODD)]
    odd += [(None, "no id here at all", "en", 1, 2, 3, 4), (None, None, None, None, None, None, None)]
    base = read_table(spark, SF_SMALL, "documents").selectExpr(
        "doc_id", "text", "lang", "1 AS score", "2 AS spans", "n_chars", "3 AS ids")
    return base.union(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def grouped(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c))
               for i, c in enumerate(reversed(d))) % 10 == 0


def digits(t):
    return re.sub("[^0-9]", "", t)


SECRET = [("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
           lambda m: len(m[2]) >= 6),
          ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
PRIVATE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
           ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
           ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
           ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15)]


def spans(text, rules, by_start):
    found = [(i, m.start(), k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    found.sort(key=lambda s: (s[1], s[0]) if by_start else s)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, a, k, b in found).encode()).hexdigest()


def test_secrets_match_plain_search(docs, rows):
    got = grouped((r["doc_id"], r["base_sha256"]) for r in secrets.digest(secrets.scan(docs)).collect())
    assert got == grouped((r["doc_id"], spans(r["text"], SECRET, True)) for r in rows)


def test_trigram_queries():
    for rule in secrets.RULES:
        for text in ("token = abcdef", "AKIA" + "Z" * 16, "ghp_" + "a" * 36, "xoxb-1234567890", "sk_live_" + "9" * 16):
            q = secrets.trigram_query(rule.regex)
            if q is not None and re.search(rule.regex, text):
                grams = {text.lower()[i:i + 3] for i in range(len(text))}
                assert any(s <= grams for s in q)
    assert secrets.trigram_query("[0-9a-f]{24,}") is None


def test_personal_data_matches_plain_search(docs, rows):
    scanned = pii.scan(docs)
    got = grouped((r["doc_id"], r["base_sha256"]) for r in pii.digest(scanned).collect())
    assert got == grouped((r["doc_id"], spans(r["text"], PRIVATE, False)) for r in rows)
    added = {s["kind"] for r in scanned.collect() for s in r["pii_spans"]}
    assert {"iban", "ssn", "pan"} <= added


def test_ibans_before_other_words(spark):
    numbers = ["AT61 1904 3002 3457 3201", "ES9121000418450200051332", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466",
               "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947",
               "GB82 WEST 1234 5698 7654 32"]
    behind = ["", " Bitte", " The", " 2024", " 17", " A", ".", " 12345 x", " DE89 3704 0044 0532 0130 00"]
    rows = [(i, f"to {n}{b}", n, b) for i, (n, b) in enumerate((n, b) for n in numbers for b in behind)]
    rows += [(1000, "x AT61 1904 3002 3457 3202 Bitte", None, None), (1001, "DE89370400440532013000abc", None, None)]
    out = pii.scan(spark.createDataFrame(rows, "doc_id long, text string, number string, behind string")).collect()
    for r in out:
        found = [(s["start"], s["text"]) for s in r["pii_spans"] if s["kind"] == "iban"]
        if r["doc_id"] >= 1000:
            assert found == ([] if r["doc_id"] == 1000 else [(0, "DE89370400440532013000")])
            continue
        whole = [(3, r["number"])]
        if r["behind"].startswith(" DE"):
            whole.append((4 + len(r["number"]), r["behind"][1:]))
        assert found == whole, r["text"]
    left = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, number string, behind string")
                      .where("number IS NOT NULL")).collect()
    assert all(r["text"].startswith("to [IBAN]") for r in left)


def test_redaction(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    left = pii.scan(out).where(F.size(F.filter("pii_spans", lambda s: s["kind"].isin("email", "ip", "card", "iban"))) > 0)
    assert left.count() == 0
    changed = out.where("text LIKE '%[EMAIL]%'").collect()
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)


def test_encoder_equals_library():
    import random
    import pyarrow as pa
    enc, r = tokens.Encoder(tokens.vocabulary_path()), random.Random(1)
    texts = ODD + ["".join(r.choice([" ", "\n", "a", "é", "'s", "_", "½", "b.", "漢", "!", "\x85", "c,\n"])
                           for _ in range(r.randrange(50))) for _ in range(300)]
    for _ in range(2):                                             # cold and warm cache
        made = enc.encode(pa.array(texts, pa.string()))
        assert made == [np.array(enc.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def plain_ids(rows, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    return [(r["doc_id"], np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [end], "<u4")) for r in rows]


def test_token_index_round_trip(spark, docs, rows):
    path = shared_path(spark, "test-index")
    token_index.write(docs, path)
    out = token_index.read_all(docs, path).collect()
    assert grouped((r["doc_id"], (r["n_tokens"], r["ids_crc32"])) for r in out) == grouped(
        (k, (len(x), zlib.crc32(x.tobytes()))) for k, x in plain_ids(rows, 0))
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    missing = spark.createDataFrame([(77 * 10 ** 9,), (10 ** 9,)], "k long")
    assert [r["key"] for r in token_index.lookup(missing, path).collect()] == [10 ** 9]


def test_minimal_perfect_hash():
    keys = token_index.key_bits(np.arange(0, 70_000, 7))
    sizes, bits = token_index.mphf_build(keys)
    assert sorted(token_index.mphf_slots(keys, sizes, bits).tolist()) == list(range(len(keys)))


def test_token_index_stored_ranks():
    keys = token_index.key_bits(np.arange(0, 70_000, 7))
    sizes, bits = token_index.mphf_build(keys)
    packed, ranks = token_index.pack_bits(bits)
    assert (token_index.stored_slots(keys, sizes, packed, ranks) == token_index.mphf_slots(keys, sizes, bits)).all()
    assert len(ranks) == -(-len(bits) // token_index.RANK_BITS)


def test_token_index_fetch_reads_its_blocks_only(spark, docs, rows, monkeypatch, tmp_path):
    """Files and row groups that hold no asked key are made unreadable."""
    import glob
    import shutil

    import pyarrow.parquet as pq
    monkeypatch.setattr(token_index, "BLOCK_DOCS", 20)
    monkeypatch.setattr(token_index, "GROUP_BYTES", 4096)
    path = str(tmp_path / "index")
    token_index.write(docs, str(tmp_path / "written"))
    shutil.copytree(tmp_path / "written", path, ignore=shutil.ignore_patterns("*.crc"))
    keys = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    wanted = [keys[3], keys[len(keys) // 2], 10 ** 15]
    asked = spark.createDataFrame([(k,) for k in wanted], "k long")
    at = {(r["shard"], r["block"]) for r in token_index.places(asked, path).collect()}
    spoilt = 0
    for name in glob.glob(f"{path}/payload/part-*.parquet"):
        meta, data = pq.ParquetFile(name).metadata, bytearray(open(name, "rb").read())
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            low = {group.column(i).path_in_schema: group.column(i).statistics for i in (0, 1)}
            held = {(low["shard"].min, b) for b in range(low["block"].min, low["block"].max + 1)}
            if held & at:
                continue
            spoilt += 1
            for i in range(group.num_columns):
                c = group.column(i)
                first = c.dictionary_page_offset or c.data_page_offset
                data[first:first + c.total_compressed_size] = b"\xff" * c.total_compressed_size
        open(name, "wb").write(data)
    assert spoilt > 5
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    got = token_index.fetch(asked, path).collect()
    assert grouped((r["key"], r["ids"]) for r in got) == grouped(
        (k, x.tobytes()) for k, x in plain_ids(rows, 0) if k in wanted)


def test_token_index_fetch_of_copies_over_blocks(spark, monkeypatch):
    """A key goes on in later blocks and shards; null keys are in no slot."""
    monkeypatch.setattr(token_index, "BLOCK_DOCS", 7)
    said = [(5, f"one {i}") for i in range(40)] + [(4, "two"), (6, None), (None, "three"), (7, "four"), (7, "four")]
    docs, path = spark.createDataFrame(said, "doc_id long, text string"), shared_path(spark, "test-index")
    token_index.write(docs, path)
    assert spark.read.parquet(f"{path}/runs").count() > 3
    plain = plain_ids([{"doc_id": k, "text": t} for k, t in said], 0)
    for limit in (token_index.ASKED_AT_ONCE, 1):                    # sent to the blocks, and by a shuffle
        monkeypatch.setattr(token_index, "ASKED_AT_ONCE", limit)
        got = token_index.fetch(spark.createDataFrame([(5,), (6,), (7,), (8,), (None,)], "k long"), path).collect()
        assert grouped((r["key"], r["ids"]) for r in got) == grouped((k, x.tobytes()) for k, x in plain if k in (5, 6, 7))
    out = token_index.read_all(docs, path).collect()
    assert grouped((r["doc_id"], r["ids_crc32"]) for r in out) == grouped((k, zlib.crc32(x.tobytes())) for k, x in plain)
    assert sorted(r["start"] for r in out) == np.cumsum([0] + [r["n_tokens"] for r in sorted(out, key=lambda r: r["start"])])[:-1].tolist()


def test_token_index_raises_for_a_lost_key(spark):
    docs, path = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), shared_path(spark, "test-index")
    token_index.write(docs, path)
    with pytest.raises(Exception, match="not in the index"):
        token_index.read_all(docs.where("doc_id = 1"), path).collect()


def test_packing(docs, rows):
    out = packing.pack(packing.pieces(docs)).collect()
    whole = grouped((k, (len(x), zlib.crc32(x[:(len(x) - 1) % 1024 + 1].tobytes()))) for k, x in plain_ids(rows, 2))
    first = [r for r in out if r["piece"] == 0]
    total = grouped((r["doc_id"], r["ids_crc32"]) for r in first)
    assert total == {k: sorted((c for _, c in v), key=repr) for k, v in whole.items()}
    assert sum(r["length"] for r in out) == sum(n for v in whole.values() for n, _ in v)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in out) // 1024) * 1.05 + 1


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 3, 3, 2])
    worse = [[0], [1], [2, 3], [4, 5]]
    out = packing.local_search([list(b) for b in worse], lengths, 12)
    assert sorted(x for b in out for x in b) == list(range(6)) and len(out) == 2


def test_equal_pieces_are_dealt_apart(spark):
    n = 3 * packing.SHARD_PIECES
    same = spark.range(n).selectExpr("CAST(NULL AS bigint) AS doc_id", "0 AS piece", "0L AS start", "600L AS length", "7L AS ids_crc32")
    out = packing.pack(same.union(spark.range(n).selectExpr("id", "0", "0L", "400L", "id"))).cache()
    shards = out.groupBy((F.col("sequence_id").bitwiseAND(-(1 << 24))).alias("shard")).count()
    assert shards.agg(F.max("count")).first()[0] < 1.2 * packing.SHARD_PIECES
    fills = out.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
    assert out.count() == 2 * n and fills.agg(F.max("fill")).first()[0] <= 1024
    assert fills.count() <= 1.05 * n


def test_equal_bins_are_searched_once():
    import time
    t = time.process_time()
    assert len(packing.pack_lengths(np.full(30_000, 600), 1024)) == 30_000
    assert len(packing.pack_lengths(np.array([600] * 3000 + [1] * 3000), 1024)) == 3000
    assert time.process_time() - t < 10


def test_local_search_looks_at_all_pairs():
    # the only pair that fits (50 + 51 for 100) is the last of 105
    own = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 50, 51)
    assert packing._best_step(own, {(100, 922): [0]}, 1023) == ([50, 51], (100, 922), [100])
    # smallest and largest of three are no neighbours
    assert packing._best_step((20,), {(3, 7, 16): [0]}, 27) == ([20], (3, 7, 16), [3, 16])


def test_local_search_ends_without_a_step():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(20, 90, 200)
        bins = packing.local_search(packing.best_fit(lengths, 256), lengths, 256)
        assert sorted(x for b in bins for x in b) == list(range(200))
        kinds = [tuple(sorted(int(lengths[x]) for x in b)) for b in bins]
        for k in kinds:
            fuller = {o: [0] for o in kinds if sum(k) < sum(o) < 256}
            assert sum(k) == 256 or packing._best_step(k, fuller, 256) is None


def test_hamming_search_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 40)), 3, axis=0).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (None, [1.0]), (502, [None, float("nan"), 2.0])]
    vec = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    coded, n = hamming.codes(vec)
    got = grouped((r["query_id"], (r["rank"], r["distance"], r["id"]))
                  for r in hamming.search(coded, n, F.col("id") % 10 == 0, 5).collect())
    bits = {i: [1 if v is not None and v > 0 else 0 for v in e] + [0] * (40 - len(e)) for i, e in data if i is not None and e}
    for q in (i for i in bits if i % 10 == 0):
        near = sorted((sum(a != b for a, b in zip(bits[q], v)), i) for i, v in bits.items() if i != q)[:5]
        assert got[q] == [(k + 1, d, i) for k, (d, i) in enumerate(near)]


def test_pieces_are_lossless_and_reproducible(docs):
    back = pieces.decode(pieces.encode(docs))
    assert back.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    again = pieces.encode(docs.repartition(5))
    assert back.select("doc_id", "ids").exceptAll(again.select("doc_id", "ids")).count() == 0
    assert pieces.digest(docs).where("NOT lossless").count() == 0


def test_pieces_are_sampled_by_weight():
    grid, word, n = pieces.lattice(pieces.model_path()), "thine", 50_000
    ids, counts = grid.sample([word] * n, pieces._seeds(list(range(n)), 0))
    seen = {}
    for x in np.split(ids, np.cumsum(counts)[:-1]):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1

    def paths(s):
        if not s:
            return [((), 1.0)]
        return [((grid.weights[s[:i]][0],) + p, float(np.exp(grid.weights[s[:i]][1])) * w)
                for i in range(1, len(s) + 1) if s[:i] in grid.weights for p, w in paths(s[i:])]
    every = paths(word)
    z = sum(w for _, w in every)
    assert set(seen) <= {p for p, _ in every}
    assert max(abs(seen.get(p, 0) / n - w / z) for p, w in every) < 0.01


def test_fingerprints(docs, rows):
    out = fingerprint.digest(fingerprint.edited_pairs(docs)).collect()
    assert len(out) == len(rows)
    ids = sorted({(-2 ** 63 if r["doc_id"] is None else r["doc_id"]) for r in rows})
    texts = grouped((-2 ** 63 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows)
    by = {r["doc_id"]: r for r in out}
    for a, b in zip(ids, ids[1:]):
        if len(set(texts[a])) == len(set(texts[b])) == 1:
            x, y = texts[a][0], texts[b][0]
            c = len(x) // 4
            assert by[a]["edited_sha256"] == hashlib.sha256((x[:len(x) - c] + y[:c]).encode()).hexdigest()
            assert by[a]["n_chars"] == len(x) and 0 <= by[a]["near_next"] <= by[a]["near_edited"] + 1
    same = grouped((r["fingerprint"], 0) for r in out if r["n_chars"] == 33)
    assert len(same) == 1


def test_sketches_merge(spark):
    text = [" ".join(f"a{i}" for i in range(s, s + 400)) for s in (0, 200, 400)]
    df = fingerprint.with_sketches(spark.createDataFrame([(1, t) for t in text], "g int, t string"), {"sketch": F.col("t")})
    one = fingerprint.merge_sketches(df, ["g"]).select(fingerprint.distinct_shingles(F.col("sketch")).alias("n")).first()["n"]
    assert abs(one - 796) < 796 * 0.3
    pair = df.limit(2).agg(F.collect_list("sketch").alias("s")).select(
        fingerprint.resemblance(F.col("s")[0], F.col("s")[1]).alias("j"),
        fingerprint.containment(F.col("s")[0], F.col("s")[1]).alias("c")).first()
    assert abs(pair["j"] - 196 / 596) < 0.2 and abs(pair["c"] - 196 / 396) < 0.25


def test_whole_sketches_compare_exactly(spark):
    x, y = " ".join(f"a{i}" for i in range(104)), " ".join(f"a{i}" for i in range(60, 170))   # 100 and 106 shingles
    pair = fingerprint.with_sketches(spark.createDataFrame([(x, y)], "x string, y string"), {"a": F.col("x"), "b": F.col("y")})
    r = pair.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"),
                    fingerprint.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert r["j"] == 40 / 166 and abs(r["c"] - 40 / 100) < 1e-12


def brute_links(rows, width, percent):
    sets, ids = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        s = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
        if r["doc_id"] is not None and s:
            sets.append(s)
            ids.append(r["doc_id"])
    up = {r["doc_id"]: r["doc_id"] for r in rows if r["doc_id"] is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j]) if abs(len(sets[i]) - len(sets[j])) <= max(len(sets[i]), len(sets[j])) / 4 else 0
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(ids[i]), top(ids[j])))
                up[b] = a
    return {x: top(x) for x in up}


def test_links_match_all_pairs(spark, docs, rows):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(5)
    base = [str(words[i % 8]) + str(i) for i in range(60)]
    copies = []
    for i in range(90):                                       # a group around the bound, in long lists
        w = list(base)
        for j in rng.choice(60, size=int(rng.integers(0, 4)), replace=False):
            w[j] = f"x{i}_{j}"
        copies.append((5000 + i, " ".join(w)))
    extra = spark.createDataFrame(copies, "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra)
    out = neardup.link(table, width=4).collect()
    expected = brute_links(rows + extra.collect(), 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_an_id_on_different_texts_is_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(3, b), (5, a), (5, b), (7, a), (9, "c1 c2 c3 c4 c5 c6"), (11, None), (None, a)]
    out = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [
        (0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (11, 11, True)]
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{i}_{j}" for j in range(20)) for i in range(40)]
    rows = [(int(i), texts[t]) for i, t in zip(rng.integers(0, 60, 70), rng.integers(0, 40, 70))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_links(table.collect(), 4, 80)
    assert all(r["component_id"] == expected[r["doc_id"]] for r in neardup.link(table, width=4).collect())


def test_language_and_toxicity_held_out(spark, docs):
    model = langid.fit(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    out = langid.identify(docs, model)
    assert out.where("lang_pred = 'und'").select("text").distinct().count() >= 2
    known = out.where("lang IS NOT NULL AND doc_id < 1000000000 AND lang_pred <> 'und'")
    assert known.where("lang = lang_pred").count() >= 0.95 * known.count()
    labels = read_table(spark, SF_SMALL, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, crc_bucket(F.col("doc_id"), 3) != 1))
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_fuzzy_trie_against_edit_distance():
    terms = [("moron", False), ("pathetic", False), ("lowei", True), ("bad", False)]
    trie = toxicity.FuzzyTrie(terms, frozenset({"marons"}))

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]
    for w in ("moron", "mor0n", "morn", "morron", "maron", "marons", "pathetic", "patetik", "pathtc", "path", "loweiung",
              "lowe", "bad", "bat", "oron", "mornoo", "clean"):
        best = min((edits(w, t) for t, s in terms if not s and t[0] == w[0]
                    and edits(w, t) <= toxicity.edits_allowed(t, s)), default=None)
        if w.startswith("lowei"):
            best = 0
        assert trie.match(w) == (None if w == "marons" else best), w


def test_inflected_terms_keep_their_edits(spark):
    forms = ["stupid"] * 12 + ["stupidly"] * 9 + ["stupiid"] * 9
    rows = [(i, 1, f"a{i} {w} b{i}") for i, w in enumerate(forms)] + [(100 + i, 0, f"a{i} plain b{i}") for i in range(60)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    stems = [t for t, is_stem in terms if is_stem]
    assert stems and {("stupid", False), ("stupidly", False)} <= set(terms)
    trie = toxicity.Scanner(terms, frozenset({"stun"})).trie
    assert {w: trie.match(w) for w in ("stupid", "stupidity", "stuoid", "stpid", "xtupid", "tupid", "stun")} == {
        "stupid": 0, "stupidity": 0, "stuoid": 1, "stpid": 1, "xtupid": 1, "tupid": 1, "stun": None}


def test_misspelled_stems():
    trie = toxicity.FuzzyTrie([("lowei", True), ("stup", True)], frozenset({"loweyly"}), strict=False)
    assert [trie.match(w) for w in ("loweiung", "lowiung", "xoweiung", "owei", "stqpid", "loweyly", "loweyness")] == [
        0, 1, 1, 1, None, None, None]


def test_quoted_terms_count_less():
    scan = toxicity.Scanner([("moron", False)], frozenset())
    assert scan.features('they said the word "moron" is old')[0] < scan.features("you are a moron")[0]


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = shared_path(spark, "test-empty")
    token_index.write(nothing, path)
    never = F.lit(True)
    for df in (secrets.digest(secrets.scan(nothing)), pii.digest(pii.scan(nothing)), pii.redact(nothing),
               token_index.read_all(nothing, path), packing.pack(packing.pieces(nothing)), pieces.encode(nothing),
               pieces.digest(nothing), fingerprint.digest(fingerprint.edited_pairs(nothing)), neardup.link(nothing),
               langid.identify(nothing, langid.fit(nothing, never)),
               toxicity.score(nothing, toxicity.fit(nothing, labels, never))):
        assert df.count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.search(*hamming.codes(none), F.lit(True)).count() == 0


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 14))
