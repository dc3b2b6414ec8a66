from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionspark.functions import text as T

SAMPLES = [
    "",
    "see HTTP://x.y/z?q=1 and www.site.org end",
    "a <b class='x'>bold</b> c",
    "smile \U0001F600\U0001F680 go ✂ on",
    "zero​width　wide   gap\n\ttab",
    "#topic one# #tag2# @user_1 @张三 #tag2# mail@host-x",
    "天气很好 nice_day 42 天",
    "a b a c b a",
]
TOKENS = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")


def _column(spark, column, values=SAMPLES):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, content STRING")
    return [r[0] for r in rows.select("i", column.alias("c")).orderBy("i").select("c").collect()]


def test_clean_text(spark):
    out = _column(spark, T.clean_text("content"))
    assert out == [
        "",
        "see and end",
        "a bold c",
        "smile go on",
        "zero width wide gap tab",
        "#topic one# #tag2# @user_1 @张三 #tag2# mail@host-x",
        "天气很好 nice_day 42 天",
        "a b a c b a",
    ]


def test_null_text_is_empty(spark):
    assert _column(spark, T.clean_text("content"), [None]) == [""]
    assert _column(spark, T.tokenize("content"), [None]) == [[]]
    assert _column(spark, T.entities("content"), [None]) == [[]]
    assert _column(spark, T.keywords("content", 3), [None]) == [[]]


def test_tokens_and_counts(spark):
    tokens = _column(spark, T.tokenize("content"))
    counts = _column(spark, T.token_counts(T.tokenize("content")))
    for found, counted in zip(tokens, counts):
        assert {x.token: x.n for x in counted} == dict(Counter(found))
        assert {x.token: x.pos for x in counted} == {t: found.index(t) for t in set(found)}
    cleaned = _column(spark, T.clean_text("content"))
    assert tokens == [TOKENS.findall(c) for c in cleaned]


def test_keywords_rank_by_count_then_first_place(spark):
    out = _column(spark, T.keywords("content", 2))
    tokens = _column(spark, T.tokenize("content"))
    assert out == [[w for w, _ in Counter(t).most_common(2)] for t in tokens]


def test_entities_tags_first_and_once(spark):
    # "#topic one#" has a space, so its closing mark opens the next tag.
    assert _column(spark, T.entities("content"))[5] == ["tag2", "user_1", "张三", "host-x"]


def test_content_words(spark):
    values = ["The THE cat httpx www2 42 天 天气 ab", None]
    assert _column(spark, T.content_words("content"), values) == [["the", "the", "cat", "天气"], []]


def test_lexicon(spark):
    values = ["good good bad", "bad worry", "Good", "", "赞 差", "我很喜欢这个产品，非常满意", "服务糟糕，太失望", "我不满意"]
    out = _column(spark, T.lexicon_sentiment("content"), values)
    assert [(x.label, x.score, x.positive, x.negative) for x in out] == [
        ("positive", 1, 2, 1),
        ("negative", -2, 0, 2),
        ("neutral", 0, 0, 0),
        ("neutral", 0, 0, 0),
        ("neutral", 0, 1, 1),
        ("positive", 2, 2, 0),
        ("negative", -2, 0, 2),
        ("negative", -1, 0, 1),
    ]


@pytest.mark.parametrize("good", ["天气", "plain", "é"])
def test_repair_mojibake(spark, good):
    broken = good.encode("utf-8").decode("latin-1")
    assert _column(spark, T.repair_mojibake("content"), [broken, good]) == [good, good]


def test_word_after_a_limit_is_kept(spark):
    """Whole texts are read: the last token of a long text counts."""
    long = " ".join(f"w{i}" for i in range(30_000)) + " last last"
    counts = _column(spark, T.keywords("content", 1), [long])
    assert counts == [["last"]]


def test_preview(spark):
    from opinionspark.functions.values import content_preview

    assert _column(spark, content_preview(), ["x" * 100, "天" * 101, None]) == ["x" * 100, "天" * 100 + "...", ""]
    assert _column(spark, F.length(content_preview()), ["天" * 200]) == [103]
