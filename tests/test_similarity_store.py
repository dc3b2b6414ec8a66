"""Groups that grow batch by batch against one run over all posts."""

from __future__ import annotations

import os
import random
import shutil

import pytest

from conftest import post
from opinionspark.operators import similarity, similarity_store, tiles
from opinionspark.operators.similarity_store import SimilarityStore
from opinionspark.sources.snapshots import version_folder


def some_posts():
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(14)] for _ in range(9)]
    rows = []
    for i in range(120):
        words = list(base[i % 9])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 60)}"
        rows.append(post(i * 2, " ".join(words)))
    return rows + [post(1, None), post(3, ""), post(5, "!!"), post(7, "alone here"), post(9, "alone here")]


def all_groups(frame):
    return {r.post_id: r.text_similarity_group for r in frame.collect()}


@pytest.mark.parametrize("tile", [1000, 3])
def test_batches_give_the_groups_of_one_run(spark, make_posts, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(similarity_store, "_TILE", tile)
    rows = some_posts()
    random.Random(5).shuffle(rows)
    store = SimilarityStore(spark, str(tmp_path / "s"), 0.6)
    for part in (rows[:60], rows[60:61], rows[61:]):
        store.add(make_posts(part))
    expected = all_groups(similarity.text_clusters(make_posts(rows), 0.6, measure="jaccard"))
    assert all_groups(store.groups()) == expected
    assert len(set(expected.values())) > 5
    assert store.add(make_posts(rows[:7])) == 4  # known posts change nothing
    assert all_groups(store.groups()) == expected


def test_a_batch_merges_groups(spark, make_posts, tmp_path):
    store = SimilarityStore(spark, str(tmp_path / "s"), 0.5)
    store.add(make_posts([post(1, "a b c d"), post(2, "e f g h"), post(4, "a b c d")]))
    assert all_groups(store.groups()) == {1: 0, 2: -1, 4: 0}
    store.add(make_posts([post(0, "c d e f"), post(3, "a b c d e f"), post(5, "c d e f g h")]))
    assert all_groups(store.groups()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        SimilarityStore(spark, str(tmp_path / "s"), 0.6).add(make_posts([post(9, "z")]))


def test_earlier_texts_are_not_read(spark, make_posts, tmp_path):
    """The store has no text of its posts, and a failed batch leaves it as it was."""
    path = str(tmp_path / "s")
    store = SimilarityStore(spark, path, 0.6)
    store.add(make_posts([post(1, "some secret words"), post(2, "some secret words too")]))
    for folder, _, names in os.walk(path):
        assert not any(b"secret" in open(os.path.join(folder, n), "rb").read() for n in names)
    before = all_groups(store.groups())
    with pytest.raises(Exception):
        store.add(make_posts([post(3, "x")]).selectExpr("post_id", "raise_error('lost') as content"))
    assert all_groups(store.groups()) == before
    shutil.rmtree(os.path.join(version_folder(spark, path), "posts"))
    with pytest.raises(Exception):
        store.groups().collect()


def test_small_stores(spark, make_posts, tmp_path):
    store = SimilarityStore(spark, str(tmp_path / "s"))
    store.add(make_posts([]))
    assert all_groups(store.groups()) == {}
    store.add(make_posts([post(4, "one")]))
    assert all_groups(store.groups()) == {4: 0}
    store.add(make_posts([post(2, "")]))
    assert all_groups(store.groups()) == {4: -1, 2: -1}


def test_texts_of_a_block_are_linked_when_it_is_made(spark):
    rng = random.Random(5)
    base = [sorted(rng.sample(range(-500, 500), 30)) for _ in range(4)]
    rows = [(10 * i + k, [t for t in tokens if t != tokens[k]]) for i, tokens in enumerate(base) for k in range(6)]
    made = tiles.set_blocks(spark.createDataFrame(rows, "rep long, tokens array<long>"), 30 * len(rows), 0.6, 1000)
    assert made.count() == 1
    links = tiles.meet(made, None, "jaccard", 0.6, 1000, links=True).collect()
    assert len(links) == 4 * 5
    assert {(r.a // 10, r.b // 10) for r in links} == {(i, i) for i in range(4)}
    assert made.selectExpr("group is not null and length(group) > 8").first()[0]


def test_only_sets_are_shuffled(spark, make_posts, tmp_path):
    store = SimilarityStore(spark, str(tmp_path / "store"), 0.6)
    store.add(make_posts([post(i, f"one two three four {i}") for i in range(5)]))
    assert not list((tmp_path / "store").rglob("order"))
