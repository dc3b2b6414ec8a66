"""Dictionary words of Chinese text, and operators with a tokenizer of the user's."""

from __future__ import annotations

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import post
from opinionspark import execute
from opinionspark.functions.segment import Dictionary, dictionary_of, dictionary_tokenizer, read_dictionary
from opinionspark.operators import keywords, labels, similarity


def ways(run):
    """All ways to cut a run."""
    for n in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), n):
            edges = [0, *cuts, len(run)]
            yield [run[a:b] for a, b in zip(edges, edges[1:])]


def test_paths_are_the_most_probable():
    rng = random.Random(2)
    for _ in range(150):
        letters = "一丁七万"[: rng.randint(2, 4)]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(1, 9))}
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        known = Dictionary(words)

        def cost(way):
            """None where a word is neither known nor a single character at which no known word begins."""
            total, at = 0, 0
            for w in way:
                if w in words:
                    total += known.costs[w]
                elif len(w) == 1 and not any(run.startswith(x, at) for x in words):
                    total += known.unknown
                else:
                    return None
                at += len(w)
            return total

        priced = [(c, [-len(w) for w in way], way) for way in ways(run) if (c := cost(way)) is not None]
        assert known.cut(run) == min(priced)[2]


def test_runs_cut_together_are_cut_alike(monkeypatch):
    """Many short runs in one go, longer ones and other characters between them, as ``cut`` takes each alone."""
    monkeypatch.setattr("opinionspark.functions.segment.TOGETHER", 30)
    monkeypatch.setattr("opinionspark.functions.segment.SHORT_RUN", 12)
    rng = random.Random(5)
    for _ in range(200):
        letters = "一丁七万"[: rng.randint(1, 4)]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(rng.randint(0, 9))}
        known = Dictionary(words)
        runs = ["".join(rng.choice("一丁七万丈") for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 40]))) for _ in range(rng.randint(0, 20))]
        assert known.cut_all(runs) == ["\n".join(known.cut(run)) for run in runs]


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("北京 50 n\n大学 40\n北京大学 30 nt\n京大\n 学生  20 n\nlatin 9\n北京 7\n\n坏 x\n", encoding="utf-8")
    words = read_dictionary(spark, str(path))
    known = dictionary_of(words)
    assert set(known.costs) == {"北京", "大学", "北京大学", "京大", "学生", "坏"}
    assert known.cut("北京大学学生") == ["北京大学", "学生"] and known.cut("京大生") == ["京大", "生"]
    cut = dictionary_tokenizer(words)
    rows = [(0, "北京大学的学生 said OK_2!"), (1, "no Chinese here"), (2, None), (3, ""), (4, "好 https://x.y/北京 <b>大学</b>")]
    posts = spark.createDataFrame(rows, "post_id long, content string")
    got = {r.post_id: r.tokens for r in keywords.post_tokens(posts, cut).collect()}
    assert got == {
        0: ["北京大学", "的", "学生", "said", "OK_2"], 1: ["no", "Chinese", "here"], 2: [], 3: [], 4: ["好", "大学"],
    }
    top = keywords.keywords_topn(posts.withColumn("content", F.concat(F.lit("大学大学"), "content")), 1, cut)
    assert {r.post_id: (r.keyword, r.n) for r in top.collect()}[1] == ("大学", 2)


def test_dictionaries_are_bounded(spark, monkeypatch):
    from opinionspark.functions import segment

    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    words = spark.createDataFrame([("一", 1), ("丁", 1), ("七", 1)], "word string, freq long")
    with pytest.raises(ValueError):
        dictionary_of(words)
    assert set(dictionary_of(words.limit(2)).costs) <= {"一", "丁", "七"}


def test_operators_take_a_tokenizer(make_posts):
    """A tokenizer on Arrow batches reaches every operator on tokens."""

    @F.pandas_udf("array<string>")
    def letters(text):
        return text.map(lambda t: [*t.replace(" ", ""), None] if t else None)

    posts = make_posts([post(0, "aab"), post(1, "ba a"), post(2, "xyz"), post(3, None)])
    assert keywords.post_tokens(posts, letters).orderBy("post_id").first().tokens == ["a", "a", "b"]
    tfidf = {(r.post_id, r.rank): r.keyword for r in keywords.keywords_tfidf(posts, 1, letters).collect()}
    assert tfidf[(0, 1)] == "a" and tfidf[(2, 1)] == "x"
    groups = {r.post_id: r.text_similarity_group for r in similarity.text_clusters(posts, tokenizer=letters).collect()}
    assert groups[0] == groups[1] == 0 and groups[2] == -1
    pairs = similarity.similar_pairs_jaccard(posts, 0.5, tokenizer=letters).collect()
    assert [(r.a, r.b, r.similarity) for r in pairs] == [(0, 0, 1.0)]
    enriched = keywords.nlp_enrich(posts, keyword_top_n=1, tokenizer=letters).orderBy("post_id").collect()
    assert [r.keywords for r in enriched] == [["a"], ["a"], ["x"], []]
    words = execute("keyword_wordcloud", posts, top_n=2, tokenizer=letters)["keywords"].collect()
    assert [(r.keyword, r["count"]) for r in words] == [("a", 2), ("b", 2)]
    found = execute("text_cluster_analysis", posts, tokenizer=letters)["clusters"].collect()
    assert [(r.text_similarity_group, r["count"]) for r in found] == [(0, 2)]


def test_labelers_fill_gaps(make_posts):
    @F.pandas_udf("string")
    def model(text):
        return text.map(lambda t: None if t is None or "?" in t else "4")

    posts = make_posts([post(0, "a", sentiment_polarity="1"), post(1, "b"), post(2, "c?"), post(3, "d")])
    labelers = {"sentiment_polarity": model, "publisher": lambda text: F.when(text == "d", "bogus").otherwise(F.lit("q"))}
    out = labels.label_posts(posts, labelers, {"publisher": F.array(F.lit("q"))}).orderBy("post_id")
    assert [(r.sentiment_polarity, r.publisher) for r in out.collect()] == [(1, "q"), (4, "q"), (None, "q"), (4, None)]
    assert out.columns == posts.columns


def test_links_tags_and_wide_gaps_go_before_words_are_joined(spark, tmp_path):
    """The query over texts with links, tags and repeated spaces equals its SQL."""
    import duckdb

    from opinionspark.plans.oracles import ORACLES
    from opinionspark.plans.queries import QUERIES

    texts = ["see www.some.example/a b c d", "one  two\tthree four", "a <b c d> e f", "plain words here", None]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, "one two three four see words a b here")], "item_id long, text string").coalesce(1).write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["tokenize_dictionary"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duck.execute(ORACLES["tokenize_dictionary"]).fetchall())


def test_texts_are_cut_once(spark):
    """Copies are found and named from keys that were made once."""
    cut = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        cut.add(len(texts))
        return texts.str.split(" ")

    posts = spark.createDataFrame([(i, f"a b{i % 3} c") for i in range(9)], "post_id long, content string")
    assert similarity.text_copies(posts, tokenizer=lambda text: words(text)).count() == 9
    assert cut.value == 9
