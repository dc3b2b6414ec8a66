from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from opinionspark.llm import language, lexical, merkle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, counts in held:
            m = 100 - 25 + (25 * sum(counts.values()) * n) // total
            score = 0
            for term, times in Counter(terms(text)).items():
                if term in counts:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += times * w * ((10**9 * counts[term]) // (1000 * counts[term] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def words(rng, n, of=300):
    """Words of falling frequency."""
    return " ".join(f"w{int(of * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("shard", [16, 1 << 14])
def test_ranked_search(spark, docs, monkeypatch, shard):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(7, "w1 w2 W3"), (7, "w1 w2 W3"), (None, "w1 w1 é-É"), (None, "w2"), (2000, None), (2001, ""), (2002, " .,\n")]
    rows += [(2003, "w7 " * 50_000 + "É_x1 x1"), (2004, "x1_X1")]
    asked = [(1, words(rng, 30)), (2, rows[5][1]), (3, "É w1 x1 x1 X1"), (4, None), (5, "zzz"), (None, "w2"), (6, "w9"), (6, "w9"), (6, "w10 w11")]
    items = spark.createDataFrame([(*a, 0, "") for a in asked], "item_id long, text string, item int, doc_id string")
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "STEP", 2)
    expected = brute_search(rows, asked, 20)
    for block in (1 << 24, 100):
        got = lexical.ranked_search(docs(rows), items, block_bytes=block)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert lexical.ranked_search(docs(rows).limit(0), items).collect() == []
    assert lexical.ranked_search(docs(rows), items.limit(0)).collect() == []


def test_best_positions_stop_before_the_lists_end():
    rng = np.random.default_rng(3)
    n, sizes = 5000, np.full(5000, 4)
    own = 2 + np.sort(np.argsort(rng.random((n, 38)), axis=1)[:, :4], axis=1)
    own[:30, :2] = (0, 1)  # two rare terms
    own = own.ravel()
    tfs = (1 / (1 - rng.random(len(own)))).astype(np.int64).clip(1, 50)
    shard = lexical.Shard(np.arange(n), np.full(n, 60), sizes, own, tfs, np.where(np.arange(40) < 2, 5000, 300), (n, n * 60))
    asked, times = np.arange(6), np.ones(6, np.int64)
    docs, scores, met = shard.top(asked, times, 5, 0)
    every = np.bincount(np.repeat(np.arange(n), sizes), np.where(own < 6, shard.impact_of, 0)).astype(np.int64)
    kth = np.sort(every)[-5]
    assert {(d, s) for d, s in zip(docs, scores)} == {(d, every[d]) for d in np.flatnonzero(every >= kth)}
    assert met < np.count_nonzero(every) / 4
    # A k-th score from elsewhere ends the search even earlier.
    assert shard.top(asked, times, 5, int(kth) + 1)[2] <= met


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def up_from(hashes):
    """All levels, lowest first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: up_from([leaf for _, _, leaf, _ in sorted(trees[x], key=lambda t: t[:3])]) for x in order}
    top = up_from([levels[x][-1][0] for x in order]) if order else []
    out = []
    for place, x in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            change = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h, proof = leaf_of(r, r["text"] and r["text"].translate(UPPER)) if change else leaf, ""
            for tree, start in ((levels[x], at), (top, place)):
                for level in tree[:-1]:
                    run = start // 8 * 8
                    before, after = "".join(level[run:start]), "".join(level[start + 1 : run + 8])
                    h, proof, start = digest(before + h + after), proof + before + after, start // 8
            out.append((r["doc_id"], leaf, levels[x][-1][0], top[-1][0], digest(proof), h, h == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("langs", [1, 3, 70])
def test_merkle_manifest(spark, docs, langs):
    rng = random.Random(langs)
    rows = [(i, f"Text {i}" if i % 4 else f"text {i}", "s", f"l{rng.randrange(langs)}") for i in range(150)]
    rows += [(1000, "A", None, "one"), (1001, None, "s", None), (None, "B", "s", "l0"), (None, None, None, None)]
    rows += [(5, "other", "s", "l0"), (3, "Same", "s", "l0"), (3, "Same", "s", "l0"), (2000, "É " * 40_000, "s", "é"), (2001, "", "s", "")]
    rows += [(3000 + i, "x", "s", "nine") for i in range(9)]  # a last run of one
    frame = docs(rows)
    expected = brute_manifest([r.asDict() for r in frame.collect()])
    got = merkle.manifest_proofs(frame.repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    sizes = Counter(r[6] for r in expected)
    assert sizes[False] and sizes[True]


def test_small_manifests(docs):
    for rows in ([], [(1, "A", "s", "en")], [(1, "A", "s", "en"), (2, "b", "s", None)]):
        frame = docs(rows)
        expected = brute_manifest([r.asDict() for r in frame.collect()])
        assert sorted((tuple(r) for r in merkle.manifest_proofs(frame).collect()), key=repr) == expected


# language identification


def scalar_probabilities(network, text):
    """The mean probabilities of one text, position by position."""
    p = {k: w.astype(np.float64) for k, w in network.weights.items()}
    hidden, found = language.HIDDEN, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for start in range(0, len(text), language.CHUNK):
        chunk, states = text[start : start + language.CHUNK], {}
        for k, places in (("f", range(len(chunk))), ("b", range(len(chunk) - 1, -1, -1))):
            h, states[k] = np.zeros(hidden), {}
            for t in places:
                x = p["bytes"][chunk[t]] @ p[f"{k}W"] + p[f"{k}B"]
                u = h @ p[f"{k}U"]
                z, r = sigmoid(x[:hidden] + u[:hidden]), sigmoid(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
                h = h + z * (np.tanh(x[2 * hidden :] + r * u[2 * hidden :]) - h)
                states[k][t] = h
        for t in range(len(chunk)):
            e = np.exp(np.concatenate((states["f"][t], states["b"][t])) @ p["V"] + p["v"])
            found.append(e / e.sum())
    return np.mean(found, axis=0)


def test_network_equals_a_scalar_one():
    network = language.Network(["a", "b", "c"])
    texts = [b"some bytes", b"", bytes(range(256)) * 2, b"x", b"y" * language.CHUNK, b"z" * (language.CHUNK + 1)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = network.document_probabilities(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, row in zip(texts, got):
        assert np.allclose(row, scalar_probabilities(network, text) if text else 1 / 3, atol=1e-5)


def test_gradients_are_differences():
    network = language.Network(["a", "b", "c"])
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    length, y = np.array([7, 5, 7, 1]), np.array([0, 2, 1, 1])
    steps = language.steps_of(np.arange(40, 60, dtype=np.uint8), np.array([0, 7, 12, 19]), length, 7)
    inside = np.arange(7)[:, None] < length

    def loss():
        return -(np.log(network.labels(steps, length)[:, y, np.arange(4)]) * inside).sum() / inside.sum()

    rng = np.random.default_rng(1)
    for k, g in network.gradients(steps, length, y).items():
        w = network.weights[k]
        for _ in range(4):
            at = tuple(rng.integers(s) for s in w.shape)
            kept, values = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = kept + step
                values.append(loss())
            w[at] = kept
            assert abs((values[0] - values[1]) / 2e-3 - g[at]) < 1e-5, k


def test_languages(spark, docs):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.languages(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == frame.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_odd_languages(docs):
    known = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 9, "s", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "s", "en"), (101, "", "s", None), (102, "123 .,!", "s", "de"), (None, "the and the cat", "s", "de"), (None, "the and the cat", "s", None)]
    odd += [(103, "und der die " * 20_000, "s", None)]
    got = {}
    for r in language.languages(docs(known + odd), chunks=4).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100][0].score == 0
    assert [r.lang_pred for r in got[None]] == ["en", "en"] and not any(r.held_out for r in got[None])
    assert got[103][0].lang_pred == "de" and got[103][0].score > 0.9
    assert language.languages(docs([])).collect() == []
    none = language.languages(docs([(1, "abc", "s", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    alone = language.languages(docs([(i, "abc", "s", "xx") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("xx", 1.0)}


def test_frequent_languages_are_thinned_out(spark, docs):
    """Of a language with many documents as many are learned from as of a rare one."""
    rows = [(i, "the cat and the dog ", "s", "en") for i in range(3000)] + [(5000 + i, "der hund und die katze ", "s", "de") for i in range(20)]
    found = []
    spread = language.train

    def noted(chunks, y, langs, *more):
        found.append(np.bincount(y).tolist())
        return spread(chunks, y, langs, *more)

    language.train = noted
    try:
        network = language.learned(docs(rows), per_lang=30, chunks=1)
    finally:
        language.train = spread
    learned_from = sum(zlib.crc32(str(5000 + i).encode()) % 3 != 1 for i in range(20))
    assert network.langs == ["de", "en"] and found == [[learned_from, 30]]
