from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from opinionspark.llm import minhash, suffixes
from opinionspark.llm.shingles import shingles, text_slices, word_hashes

LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))


def near(rng, text, share):
    return " ".join(f"e{rng.random()}" if rng.random() < share else w for w in text.split(" "))


def corpus(n=60):
    rng = random.Random(5)
    base = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 200))) for _ in range(6)]
    rows = []
    for i in range(n):
        b = base[i % len(base)]
        rows.append((i * 3 + 1, b if i % 7 == 0 else near(rng, b, rng.choice([0.005, 0.02, 0.05]))))
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "one  two\n"), (905, "one two three"), (None, "one two"), (None, "alone " * 9), (906, LONG), (907, LONG + " end"), (908, "é" * 40), (908, "é" * 40)]


def brute_classes(rows, idf, threshold=0.8):
    sets = []
    for _, t in rows:
        ((_, _, data, offsets),) = list(text_slices(pa.array([t or ""], pa.large_string()))) 
        h, w, _ = shingles(*word_hashes(data, offsets), idf)
        sets.append(dict(zip(h.tolist(), w.tolist())))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - shared
            if a and shared >= threshold * total - 1e-9:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    names = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        names |= {i: min(ids, default=None) for i in members}
    return sorted(((rows[i][0], names[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("tile", [None, 200])
def test_near_duplicates_are_the_brute_force_classes(spark, docs, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(minhash, "FAMILY_TILE", tile)
        monkeypatch.setattr(minhash, "BAND_TILE", 4)
    rows = corpus() + [r for r in ODD if r[0] is not None]
    table = docs(rows)
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(table).collect()), key=repr)
    assert got == brute_classes(rows, minhash.word_idf(table))
    assert len({c for _, c in got}) < len(rows) - 10


def test_near_duplicates_without_ids_and_rows(spark, docs):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "quite another text of words"), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted([(None, 3), (3, 3), (None, None), (4, 4), (5, 5)], key=repr)
    assert minhash.near_duplicates(docs([])).collect() == []
    kept = minhash.one_of_each_class(docs(rows[1:] + [(9, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 4, 5]  # the text without any id, and one each


def test_rows_that_share_an_id(spark, docs):
    """Each text of an id keeps its links, in whatever order the rows come."""
    rng = random.Random(6)
    a, b = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(120)) for c in "ab")
    rows = [(1, a), (1, b), (5, b + " more"), (6, a + " more"), (0, "quite alone " * 9), (7, a)]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs(order)).collect())
        assert got == [(0, 0), (1, 1), (1, 1), (5, 1), (6, 1), (7, 1)]


def test_one_row_of_each_class_stays(spark, docs):
    text = " ".join(f"t{i}" for i in range(90))
    rows = [(1, text), (1, text), (1, text), (None, text), (4, text + " more"), (1, "words of another text stand here"), (8, None), (8, None), (9, ""), (None, ""), (None, " "), (None, "no id at all here"), (None, "no id at all here")]
    kept = minhash.one_of_each_class(docs(rows))
    assert kept.columns == docs(rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    blank = [g for g in got if g[0] is None and not (g[1] or "").strip()]
    assert len(blank) == 1
    assert sorted((g for g in got if g not in blank), key=repr) == sorted(
        [(1, text), (1, "words of another text stand here"), (8, None), (9, ""), (None, "no id at all here")], key=repr
    )


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds(spark, docs, threshold):
    """Pairs from just above the threshold to well above it are linked, and none below it."""
    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(60):
        words = [f"{k}x{rng.randint(0, 10**6)}" for _ in range(200)]
        share = threshold + (1 - threshold) * rng.choice([0.05, 0.2, 0.5])
        same = round(200 * 2 * share / (1 + share))
        other = words[:same] + [f"{k}y{rng.randint(0, 10**6)}" for _ in range(200 - same)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k, 2 * k + 1))
    table = docs(rows)
    expected = dict(brute_classes(rows, minhash.word_idf(table), threshold))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table, threshold).collect()}
    linked = [b for a, b in pairs if expected[b] == a]
    assert len(linked) >= 30 and sum(got[b] == expected[b] for b in linked) >= 0.95 * len(linked)
    assert all(got[i] == i for i in got if expected[i] == i)


def test_bands_follow_the_threshold():
    for threshold in (0.3, 0.5, 0.7, 0.8, 0.9, 1.0):
        bands, rows, least = minhash.banding(threshold)
        assert bands * rows <= minhash.SAMPLES and (1 - threshold**rows) ** bands <= 1.1e-5
        below = sum(math.comb(48, k) * threshold**k * (1 - threshold) ** (48 - k) for k in range(least))
        assert below <= 1e-6
    assert minhash.banding(0.8) == (16, 3, 24)
    for wrong in (0.1, 1.1):
        with pytest.raises(ValueError):
            minhash.banding(wrong)


def test_rare_words_weigh_alike(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "RAREST", 20)
    rows = [(i, f"all w{i} p{i % 3} q{i % 15}") for i in range(60)]
    idf = minhash.word_idf(docs(rows))
    data = b"all p1 q2 w7 new"
    hashes, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    floor = 60 / 20
    assert idf(hashes) == pytest.approx([math.log(61 / (1 + n)) + 1 for n in (60, 20, 4, floor, floor)])
    assert len(idf._words) == 1 + 3 + 15


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    sampler = minhash.Sampler(400)
    hashes = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    weights = rng.uniform(0.5, 9, 300)
    other = weights * rng.uniform(0.3, 1.5, 300)
    drawn = sampler.draw(np.tile(hashes, 2), np.concatenate((weights, other)), np.array([0, 300]))
    similarity = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs((drawn[0] == drawn[1]).mean() - similarity) < 0.08


def test_words_have_their_own_counts(spark, docs, monkeypatch):
    """Weights against counts of the words themselves, with more words than any small table has slots."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"w{rng.randint(0, 90_000)}" for _ in range(900)] + ["all", f"p{i % 60}"])) for i in range(120)]
    rows += [(1000, None), (1001, " "), (1002, "all all")]
    df = Counter(w for _, t in rows for w in set((t or "").split()))
    data = " ".join(df).encode()
    hashes, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    expected = [math.log(122 / (1 + df[w])) + 1 for w in df]
    for most in (minhash._MOST_COUNTS, 1 << 12):
        monkeypatch.setattr(minhash, "_MOST_COUNTS", most)
        assert minhash.word_idf(docs(rows))(hashes) == pytest.approx(expected, abs=1e-12)
    text = np.frombuffer(b"all p1 w5 p2 all", np.uint8)
    _, weights, _ = shingles(*word_hashes(text, np.array([0, 16])), minhash.word_idf(docs(rows)))
    known = dict(zip(df, expected))
    once = math.log(122 / 2) + 1
    assert weights == pytest.approx([sum(known.get(w, once) for w in ("all", "p1", "w5", "p2", "all")) / 5])


def brute_removed(rows):
    first = {}
    size = suffixes.LENGTH
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    raw = [(r[0] if r[0] is not None else 2**63 - 1, (r[1] or "").encode()) for r in order]
    for i, t in raw:
        for s in range(len(t) - size + 1):
            first.setdefault(t[s : s + size], i)
    out = []
    for i, t in raw:
        covered = np.zeros(len(t) + 1, int)
        for s in range(len(t) - size + 1):
            if first[t[s : s + size]] < i:
                covered[s] += 1
                covered[s + size] -= 1
        hit = np.concatenate(([0], np.cumsum(covered)[:-1] > 0)).astype(int)
        kept = bytes(b for b, h in zip(t, hit[1:]) if not h)
        out.append((None if i == 2**63 - 1 else i, len(t), int(hit.sum()), int((np.diff(hit) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


PASSAGE = "this passage is repeated, letter by letter, in a good many of the documents; é ü. "


def repeats():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(5, 60)))
        rows.append((rng.randint(0, 10**6), own + (PASSAGE[rng.randint(0, 20) :] if i % 2 else "") + own[: rng.randint(0, 200)]))
    rows += [(2, "ab" * 200), (1, "ab" * 90), (50, "x" * 49), (51, "x" * 49), (52, "y" * 50), (53, "y" * 50), (54, "z" * 5000), (55, "z" * 60)]
    rows += [(60, None), (61, ""), (None, PASSAGE * 2), (None, "only in rows without an id, but in two of them, " * 2), (None, "only in rows without an id, but in two of them, " * 2 + "!")]
    rows += [(70, "one id, two texts that share this string of more than fifty bytes, one"), (70, "one id, two texts that share this string of more than fifty bytes, two")]
    rows += [(71, PASSAGE), (71, PASSAGE), (72, "é" * 100), (73, "aé" + "é" * 30)]
    return rows


@pytest.mark.parametrize("often", [4096, 1])
def test_removed_strings_are_those_of_brute_force(spark, docs, often):
    rows = repeats()
    table = docs(rows)
    got = sorted((tuple(r) for r in suffixes.substring_digests(table, often=often).collect()), key=repr)
    assert got == brute_removed(rows)
    assert suffixes.substring_digests(docs([])).collect() == []


def test_the_largest_id_is_an_id(docs):
    text = " ".join(f"word{i}" for i in range(40))
    got = suffixes.substring_digests(docs([(2**63 - 1, text), (None, "another"), (5, text)])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=repr) == sorted([(2**63 - 1, len(text)), (None, 0), (5, 0)], key=repr)


def test_kept_documents_keep_columns(spark, docs):
    rows = [(1, PASSAGE), (2, "before " + PASSAGE + "after"), (3, "é" * 40), (4, "a" + "é" * 40 + "b")]
    table = docs(rows)
    got = {r.doc_id: r for r in suffixes.kept_documents(table).collect()}
    assert suffixes.kept_documents(table).columns == table.columns
    assert got[2].text == "before after" and got[2].n_chars == 12 and got[2].lang == "en"
    assert got[4].text == "ab"


@pytest.mark.parametrize("alphabet", [1, 2, 5, 200])
def test_suffix_ranks(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [*range(9), 60, 700]:
        text = rng.integers(1, alphabet + 1, n)
        for depth in (1, 3, 10, 50):
            order = np.argsort(suffixes.suffix_ranks(text, depth), kind="stable")
            found = [tuple(text[i : i + depth]) for i in order]
            assert found == sorted(found)


def _long_rows():
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(40)]
    return list(enumerate(texts + [t[: len(t) // 2] for t in texts]))


def test_few_bytes_of_an_anchor_are_shuffled(docs):
    rows = docs([(i, t) for i, t in _long_rows()]).selectExpr("doc_id as ident", "text")
    data = pa.array([t for _, t in _long_rows()])
    runs = sum(len(suffixes.anchor_runs(d, o)[0]) for *_, d, o in text_slices(data))
    shuffled = suffixes.anchor_table(rows, 4).selectExpr("sum(length(anchors))").first()[0]
    assert shuffled == 4 * runs


def test_regions_are_shuffled_compressed():
    text = np.frombuffer(_long_rows()[0][1].encode(), np.uint8)
    anchor, _, place, count = suffixes.anchor_runs(text, np.array([0, len(text)]))
    (batch,) = suffixes._packed_regions([((1, 1), text, anchor, place, count)], 1)
    assert sum(len(batch[c][0].as_py()) for c in batch.schema.names[1:]) < int((count + suffixes.LENGTH - 1).sum())


def test_equal_regions_are_not_sorted(docs, monkeypatch):
    sorted_ = []
    first_owners = suffixes.first_owners
    monkeypatch.setattr(suffixes, "first_owners", lambda r, o: sorted_.extend(r) or first_owners(r, o))
    text = np.frombuffer(_long_rows()[0][1].encode(), np.uint8)
    anchor, _, place, count = suffixes.anchor_runs(text, np.array([0, len(text)]))
    (batch,) = suffixes._packed_regions([((i, i + 100), text, anchor, place, count) for i in (4, 2, 9)], 1)
    found = suffixes._covered(batch.to_pandas(), 1)
    assert not sorted_
    assert suffixes._unpacked(found).tolist() == [104] * len(anchor) + [109] * len(anchor)


def test_shuffles_of_the_search_are_deleted_before_texts_are_put_out(docs, monkeypatch):
    released = []
    monkeypatch.setattr(suffixes, "release_shuffles", released.append)
    suffixes.dedup_substrings(docs(_long_rows()))
    assert len(released) == 2
