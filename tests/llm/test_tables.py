from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import TESTDATA
from opinionspark.llm import mixing, packing, rules, topk, warc
from opinionspark.llm.common import tokenizer_path
from opinionspark.llm.queries import ORACLES, QUERIES
from opinionspark.llm.shingles import text_slices

ODD_TEXTS = [None, "", " \n ", "word", "a\x0bb c\x1cd", "x " * 30_000, "#*$%&|<> " * 70, "same line\n" * 40, "é ü\r\nß " * 30]


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    frame = QUERIES[name](spark, TESTDATA)
    result = con.execute(ORACLES[name])
    names = sorted(c[0] for c in result.description)
    assert sorted(frame.columns) == names
    expected = [dict(zip([c[0] for c in result.description], row)) for row in result.fetchall()]
    key = lambda r: repr([r[n] for n in names])
    assert sorted((r.asDict() for r in frame.collect()), key=key) == sorted(expected, key=key)


# exact top-k search


def brute_top(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: min(v for j, v in whole if j == i) for i, v in whole if i % 5 == 0}.items():
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i)
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("shard", [8, 4096])
def test_top_k(spark, monkeypatch, shard):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]
    rows += [(300, None), (305, [float("nan")] * 6), (310, [None, 1.0]), (None, [1.0] * 6), (315, []), (320, [1.0, 2.0]), (325, [float("inf")])]
    rows += [(330, [1e17, 3.0]), (335, [1e300, -1e300])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, shard int, score double")
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    got = topk.top_k(frame, F.col("vec_id") % 5 == 0, 5, shard, 7)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)
    few = frame.filter("vec_id in (0, 5, 7)")
    assert topk.top_k(few, F.col("vec_id") % 5 == 0).count() == 4
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 5 == 0).collect() == []


# mixing


def brute_targets(sizes, most=2.0, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        more = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def test_mixing(spark, docs):
    rng = random.Random(6)
    rows = [(i, "w " * min(400, int(rng.lognormvariate(3, 1))), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(5000 + k, t, "odd") for k, t in enumerate(ODD_TEXTS)] + [(None, "w w w", "a"), (9500, "w w", "a"), (9500, "w w", "a"), (9000, None, "empty")]
    got = mixing.mix_sources(docs(rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken <= 2 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 20, largest[s] / 2), (s, taken[s], t)
    again = mixing.mix_sources(docs(rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs(rows)).collect())
    assert all(copies[r.doc_id] == r.taken // r["size"] for r in got if r["size"] and r.doc_id not in (9500, None))
    assert mixing.mix_sources(docs([])).collect() == []
    assert mixing.mixed_documents(docs(rows)).columns == docs(rows).columns


# quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 90)), f"s{i % 3}", ["en", None][i % 2]) for i in range(300)]
    rows += [(1000 + i, t, "s1") for i, t in enumerate(ODD_TEXTS)] + [(None, prose(80), None, None)]
    rows += [(2000, " ".join(w + "###" for w in prose(80).split()), "s1"), (2001, prose(40) + " a b c d a b c d", "s1"), (2002, " ".join(["x"] * 300), "s1")]
    got = rules.quality_rules(docs(rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i in range(300)} | {None} <= kept and not kept & {2000, 2001, 2002}
    assert rules.quality_rules(docs([])).collect() == []
    plan = rules.measured(docs(rows))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_thresholds_are_quantiles(spark, docs):
    rows = [(i, " ".join(["ab" + "c" * (i % 7)] * (60 + i)), "s", "en") for i in range(301)]
    frame = rules.measured(docs(rows))
    (limit,) = rules.thresholds(rules.sketches(frame)).collect()
    values = sorted(r.chars_per_word for r in frame.collect())
    q1, q3 = values[math.ceil(0.25 * 301) - 1], values[math.ceil(0.75 * 301) - 1]
    assert limit.high_chars_per_word == pytest.approx(q3 + rules.REACH * max(q3 - q1, 1.0))


# archives


def brute_pages(rows):
    payload = lambda h: (h or "").encode()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[payload(h)] = max(last.get(payload(h), i), i)
    out = []
    for i, _, h in rows:
        p = payload(h)
        to = last.get(p) if len(p) >= 1000 and i != last.get(p) else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


PAGES = [(i, f"http://x/{i}", f"<p>{i % 9}</p>" * 300) for i in range(60)] + [
    (100, None, None), (101, "u\r\nWARC-Type: x", ""), (102, "u", "é" * 499), (103, "u", "é" * 500), (104, "u", "é" * 500),
    (None, "u", "é" * 500), (105, "u", "WARC/1.1\r\n\r\n" * 100), (106, "u", "z" * 400_000), (None, "u", "n" * 1000), (None, "u", "n" * 1000), (107, "u", "é" * 499),
]


@pytest.mark.parametrize("most", [1, warc.ARCHIVE_BYTES])
def test_archives(spark, tmp_path, most):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, last int")
    records = warc.planned_records(pages)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(records, folder, warc.sampled_dictionary(pages), most)
    got = warc.read_archives(manifest, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_pages(PAGES)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    assert not warc.archive_pages(pages.limit(0)).collect()


def test_archive_format(tmp_path):
    samples = [warc.record_bytes(i, "u", f"<html>{i}</html>".encode() * 40, "00" * 20, None) for i in range(200)]
    raw = warc.build_dictionary(samples)
    writer = warc.ArchiveWriter(f"file://{tmp_path}", raw)
    for s in samples:
        writer.write(s)
    writer.close()
    data = open(writer.done[0][0], "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert (magic, data[8 : 8 + size]) == (0x184D2A5D, raw)
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
    assert alone.decompress(data[8 + size :]) == samples[0]  # a record is a frame
    assert warc.build_dictionary([]) == b"" and warc.build_dictionary([b"abc" * 9]) == b"abc" * 9


# packing


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["don't CAN'T it's 'S", "a<|endoftext|>b <|startoftext|>", "naïve É é İstanbul ΣΑΣ ß", "a\x1cb\x1dc", "x,y.z!! 12 3.4", "日本 語", "A" * 100, "w " * 5000]
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + odd)] + [(None, "n"), (3, "word"), (3, "word")]
    got = packing.pack_documents(docs(rows), path).collect()
    expected = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[s : s + 2048], "<u4")
            expected[(i, k, s, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), [*sorted(p)[1:], (sum(n for _, n in p), 0)]))
        assert sum(n for _, n in p) <= 2048 and min(p)[0] == 0
    assert packing.pack_documents(docs([]), path).collect() == []


def test_units_give_the_ids_of_whole_texts():
    encoder = packing.UnitEncoder(tokenizer_path("word_bpe_49k.json"))
    assert encoder.by_units
    rng = random.Random(3)
    some = [*"abcXYZ0129 \n\t.,!'-<|>éÉßÿ×÷ñÑ", "\u0301", "\x0b", "\x1c", "\xa0", "\u3000", "漢", "ǅ", "İ", "ﬁ", "'s", "<|endoftext|>", "\x00", "\x85", "😀", "ª", "Ⅷ"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for most in (1 << 10, 1 << 21):
        for first, _, data, offsets in text_slices(pa.array(texts), most):
            ids, rows = encoder.encode(data, offsets)
            for k, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
                assert ids[a:b].tolist() == encoder.whole(texts[first + k]), texts[first + k]
    assert not packing.UnitEncoder(tokenizer_path("byte_bpe_50k.json")).by_units


def test_units_are_forgotten_by_age(monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 3)
    encoder = packing.UnitEncoder(tokenizer_path("word_bpe_49k.json"))
    for text in ("some words, some", "other words", "yet more of them", "words and others", "some"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == encoder.whole(text)
        assert len(encoder._young.keys) <= 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers(docs, name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(name))
    rows = [(1, "Some CASED words, É"), (2, None), (3, " a  b ")]
    got = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs(rows), tokenizer_path(name)).collect()}
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == zlib.crc32(ids.tobytes())


def exact_bins(lengths, size):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_small_plans_are_optimal():
    rng = random.Random(1)
    saved = 0
    for case in range(120):
        lengths = [rng.randint(1, 20) if case % 2 else rng.choice([3, 6, 7, 8, 9, 11, 13]) for _ in range(9 + case % 3)]
        plan = packing.plan_sequences(Counter(lengths), 20, None)
        used = Counter()
        for sequence, times in plan:
            assert sum(sequence) <= 20
            used.update({n: c * times for n, c in Counter(sequence).items()})
        assert used == Counter(lengths)
        needed = exact_bins(lengths, 20)
        assert sum(t for _, t in plan) == needed
        counts = np.bincount(lengths, minlength=21)
        assert packing.least_sequences(counts, 20) <= needed
        saved += sum(t for _, t in packing.best_fit_plan(Counter(lengths), 20)) - needed
    assert saved > 0  # the search found what best fit doesn't


def test_fillings_are_undominated():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(1, 12) for _ in range(7)]
        counts = np.bincount(lengths, minlength=13)
        got = [tuple(f) for f in packing.Completion(12, None).fillings(counts, 12, 12)]
        every = {tuple(sorted((n for k, n in enumerate(lengths) if m >> k & 1), reverse=True)) for m in range(128)}
        for f in (f for f in every if sum(f) <= 12):
            outside = Counter(lengths) - Counter(f)
            parts = [[n for k, n in enumerate(f) if m >> k & 1] for m in range(1 << len(f))]
            better = any(
                sum(p) <= y <= sum(p) + 12 - sum(f) and (y > sum(p) or len(p) > 1) for y in outside for p in parts
            )
            assert (f in got) != better
        assert len(got) == len(set(got))


def test_searches_end():
    rng = random.Random(0)
    hard = Counter(rng.randint(300, 1100) for _ in range(120))
    best = sum(t for _, t in packing.best_fit_plan(hard, 2048))
    plan = packing.plan_sequences(hard, steps=20_000)
    assert sum(t for _, t in plan) <= best
    assert sum((Counter({n: c * t for n, c in Counter(q).items()}) for q, t in plan), Counter()) == hard


def test_large_plans_are_near_the_bound():
    rng = random.Random(1)
    big = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(100_000))
    plan = packing.plan_sequences(big)
    assert sum(t for _, t in plan) <= 1.001 * sum(n * c for n, c in big.items()) / 2048 + 1
    assert len(plan) < 8000
