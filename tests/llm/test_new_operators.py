"""Chat formatting, vector codes and the filter audit against brute force."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, filter_audit, vector_codes

CHAT = "conv_id long, turn long, role string, text string, formatted string, piece int, _r int, turns string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(t):
    text = t[3] or ""
    return (t[1] is not None, t[1] or 0, (t[2] or "").encode(), text.encode())


def chat_rows():
    odd = ["", None, "<|im_end|>", "<\\|x", "<\\\\|<|", "a<", "|im_end|>\n", "é𝒳<|turn|>\n\r", "$1 \\1 \\", "plain"]
    rows = [(1, i, ["user", "assistant", "assistant", None, ""][i % 5], t) for i, t in enumerate(odd * 3)]
    rows += [(2, 0, "we\nird%0A<|role", "x"), (2, 1, "we\nird%0A<|role", "y"), (2, 2, "assistant", "z<|")]
    rows += [(3, None, "user", "first"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (3, 5, "assistant", "other")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still"), (4, 0, "assistant", "long " * 200_000)]
    # far over a piece: runs of one role that cross pieces and ranges, hostile texts
    rows += [(7, i, "user" if i % 400 < 390 else "assistant", f"t{i} {odd[i % len(odd)]}") for i in range(2000)]
    rows += [(None, 10 + i, ["user", "assistant"][i % 2], f"n{i}") for i in range(300)]
    return rows


def test_chats_read_back_as_written(spark):
    rows = chat_rows()
    df = spark.createDataFrame([r + ("f", 1, 2, "t") for r in rows], CHAT).repartition(7)
    pieces = chat.format_chats(df).cache()
    out = {r["conv_id"]: r for r in chat.digest(pieces).collect()}
    assert set(out) == {r[0] for r in rows}
    whole = {}
    for p in sorted(pieces.collect(), key=lambda p: p["piece"]):
        whole.setdefault(p["conv_id"], []).append(p)
    for conv, got in out.items():
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        learned = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert got["n_turns"] == len(turns) and got["turns_sha256"] == sha(said), conv
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), sha(learned)), conv
        text = "".join(p["formatted"] for p in whole[conv])
        assert got["formatted_chars"] == len(text)
        roles = [t[2] or "" for t in turns]
        runs = 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") == runs
        assert text.count("<|") == 2 * runs + text.count("<|turn|>") and text.count("<|turn|>") == len(turns) - runs
    assert len(whole[7]) > 10 and max(p["formatted"].count("t") for p in whole[7]) < 10_000


def test_masks_cover_learned_texts_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "q<|"), (1, 1, "assistant", "a<|"), (1, 2, "assistant", "é")],
                               "conv_id long, turn long, role string, text string")
    p = chat.format_chats(df).first()
    assert p["formatted"] == "<|im_start|>user\nq<\\|<|im_end|>\n<|im_start|>assistant\na<\\|<|turn|>é<|im_end|>\n"
    assert [p["formatted"][s["start"]:s["end"]] for s in p["loss_spans"]] == ["a<\\|", "é"]


def brute_codes(data):
    kept = []
    for vec_id, v, label in data:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.clip(np.floor(float(np.float32(x)) * 256), -(1 << 20), 1 << 20)) for x in v], label))
    width = -(-max(len(q) for _, q, _ in kept) // 16) * 16
    kept = [(i, q + [0] * (width - len(q)), lab) for i, q, lab in kept]
    firsts = {}
    for i, q, _ in kept:
        firsts[i] = min(firsts.get(i, q), q)
    ids = sorted(firsts, key=lambda i: (i is None, i or 0))[:64]
    w = width // 16
    books = [[firsts[i][p * w:(p + 1) * w] for i in ids] for p in range(16)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, q, _ in kept:
                x = q[p * w:(p + 1) * w]
                groups.setdefault(assign(p, x)[1], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for i, q, lab in kept:
        best = [assign(p, q[p * w:(p + 1) * w]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    said = sha(",".join(str(x) for b in books for c in b for x in c))
    return sorted(((i, c, e, total[lab], said) for i, c, e, lab in out), key=repr)


VEC = "vec_id long, embedding array<float>, label int, q string, code int, row string, error string"


@pytest.mark.parametrize("case", ["usual", "few", "ties", "ragged"])
def test_codes_match_plain_rounds(spark, case):
    rng = np.random.default_rng(7)
    bad = [(900, None, 1), (901, [1.0, None] * 16, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, None)]
    if case == "usual":
        data = [(i, rng.normal(size=64).tolist(), None if i % 5 == 0 else i % 3) for i in range(300)]
        data += [(5, rng.normal(size=64).tolist(), 7)] + [(None, data[0][1], None)] * 3 + bad
    elif case == "few":
        data = [(i, rng.normal(size=32).tolist(), 1) for i in range(5)] + [(3, [0.0] * 32, 2), (4, [1e30, -1e30] * 16, 2)] + bad
    elif case == "ties":
        data = [(i, (rng.integers(-2, 3, 64) / 256).tolist(), i % 2) for i in range(250)]
    else:
        data = [(i, rng.normal(size=int(rng.integers(0, 40))).tolist(), 1) for i in range(80)]
    df = spark.createDataFrame([(i, v, lab, "q", 1, "r", "e") for i, v, lab in data], VEC).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.digest(df).collect()), key=repr)
    assert got == brute_codes(data)


def test_trees_find_the_nearest_entries():
    rng = np.random.default_rng(1)
    for n, k, w, scale in ((1, 1, 4, 9), (500, 64, 4, 30), (3000, 64, 4, 3), (900, 40, 2, 100), (700, 3, 1, 5), (40, 64, 0, 1)):
        x, c = rng.integers(-scale, scale, (n, w)), rng.integers(-scale, scale, (k, w))
        x[: n // 3] = x[0]
        label, counts, sums = vector_codes.nearest(x, c)
        plain = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (label == plain).all() and (counts == np.bincount(plain, minlength=k)).all()
        assert all((sums[j] == x[plain == j].sum(axis=0)).all() for j in range(k))


def test_vectors_without_components_and_other_columns(spark):
    df = spark.createDataFrame([(1, [], 1, "a", 2, "r", "e"), (2, [], None, "b", 3, "s", "f")], VEC)
    assert [r["code"] for r in vector_codes.digest(df).collect()] == ["00" * 16] * 2
    some = spark.createDataFrame([(i, [i / 7.0] * 16, 1, "a", i, "r", None) for i in range(9)], VEC)
    kept = vector_codes.whole_numbers(some)
    coded = vector_codes.encode(kept, vector_codes.fit(kept))
    assert sorted(r["row"]["code"] for r in coded.collect()) == list(range(9)) and coded.columns == ["row", "code", "error"]


def test_many_labels_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, f"{i:02x}", i) for i in range(50)],
                               "vec_id long, label int, code string, error long")
    out = vector_codes.with_label_totals(df, spark).collect()
    assert len(out) == 50
    for r in out:
        assert r["label_error"] == sum(i for i in range(50) if (None if i % 3 == 0 else i % 2) == r["label"])


def brute_audit(docs, labels):
    blank = re.compile(r"[^\x20\x09-\x0D]+")
    marks, first = {}, {}
    for i, q, t in labels:
        if i is not None:
            g, x = marks.get(i, (0, 0))
            marks[i] = (max(g, q == 1), max(x, t == 1))
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    seen = []
    for i, text, source in docs:
        text = text or ""
        w = blank.findall(text)
        fails = {c for c, f in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and i > first[text])) if f}
        seen.append((source or "", fails, *marks.get(i, (0, 0))))
    out = []
    for part in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [s for s in left if c in s[1]]
                left = [s for s in left if c not in s[1]]
                gone_by[c] += len(gone)
                fails = sum(c in s[1] for s in mine)
                rows.append([part, "".join(order), step, len(left), len(gone), fails - len(gone),
                             sum(s[1] == {c} for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone), c])
        out += [tuple(r[:-1]) + (gone_by[r[-1]],) for r in rows]
    return sorted(out)


def test_audit_matches_every_order(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(80)] + ["AB", "C#", "d|", "e"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(40)] + [None, "", " \t", "Ü" * 70, "A" * 90_000]
    docs = [(None if k % 17 == 0 else int(rng.integers(0, 60)), texts[int(rng.integers(0, len(texts)))],
             [None, "", "s1", "s2"][int(rng.integers(0, 4))]) for k in range(200)]
    labels = [(int(rng.integers(0, 70)) if k % 11 else None, [0, 1, None][k % 3], [1, 0, None, 0][k % 4]) for k in range(60)]
    d = spark.createDataFrame([r + (1, 2, "m", 3) for r in docs], "doc_id long, text string, source string, docs int, id int, mask string, good int")
    lab = spark.createDataFrame([r + (9,) for r in labels], "doc_id long, quality int, toxic int, good int")
    out = filter_audit.audit(d, lab).collect()
    got = sorted((r["part"], r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"],
                  r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out)
    assert got == brute_audit(docs, labels)


def test_ranks_of_orders():
    every = ["".join(p) for p in permutations("ABCDE")]
    assert [filter_audit.order_of(r) for r in range(120)] == every
    assert [filter_audit.first_rank(o) for o in every] == list(range(120))
    gone = np.zeros((32, 121), int)
    for mask, _, rank, sign in filter_audit.interval_ends():
        gone[mask, rank] += sign
    assert (np.cumsum(gone, axis=1)[1:, :120] == 1).all()        # every order removes every mask once


def test_empty_tables(spark):
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(chats)).count() == 0
    assert vector_codes.digest(spark.createDataFrame([], VEC)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "x", None)], docs.schema)
    assert filter_audit.audit(some, labels).where(F.col("good_lost") + F.col("toxic_lost") > 0).count() == 0
