"""Text functions as column expressions; no Python runs per row.

The per-post work (cleaning, tokens, token counts) stays inside one row, so
none of it needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

# What counts as a URL, a tag, an emoji, a token, an entity.
URL_PATTERN = r"(?iU)(https?://\S+|www\.\S+)"
TAG_PATTERN = r"<[^>]+>"
EMOJI_PATTERN = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
    r"\x{2700}-\x{27BF}]+"
)
SPACE_PATTERN = r"(?U)\s{2,}|[^\S ]"  # all but single plain spaces
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
WORD_PATTERN = r"[A-Za-z]{3,}|[\x{4e00}-\x{9fff}]{2,}"
HASHTAG_PATTERN = r"(?U)#([^#\s]{2,30})#"
MENTION_PATTERN = r"@([A-Za-z0-9_\-\x{4e00}-\x{9fff}]{2,30})"

# The sentiment lexicon.
POSITIVE_WORDS = (
    "好", "赞", "喜欢", "支持", "满意", "认可", "感谢", "顺利", "成功", "稳定",
    "positive", "great", "good", "love", "support",
)
NEGATIVE_WORDS = (
    "差", "糟糕", "不满", "担心", "恐惧", "失败", "失望", "抱怨", "焦虑", "愤怒",
    "negative", "bad", "hate", "angry", "worry",
)


def _column(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _without_markup(text: Column) -> Column:
    """The text with URLs and tags replaced by spaces.

    The patterns run only on texts that hold what every match starts with.
    """
    lower = F.lower(text)
    linked = F.contains(lower, F.lit("http")) | F.contains(lower, F.lit("www."))
    unlinked = F.when(linked, F.regexp_replace(text, URL_PATTERN, " ")).otherwise(text)
    tagged = F.contains(text, F.lit("<"))
    return F.when(tagged, F.regexp_replace(unlinked, TAG_PATTERN, " ")).otherwise(unlinked)


def clean_text(text: str | Column) -> Column:
    """Drop URLs, tags, emoji and zero-width spaces; squeeze whitespace."""
    source = _column(text)
    plain = _without_markup(source)
    wide = F.octet_length(source) > F.length(source)
    out = F.when(wide, F.regexp_replace(plain, EMOJI_PATTERN, " ")).otherwise(plain)
    out = F.replace(out, F.lit("\u200b"), F.lit(" "))
    return F.trim(F.regexp_replace(out, SPACE_PATTERN, " "))


#: From a column of cleaned text to a column of its tokens, array<string>: built-in functions, or a function on
#: Arrow batches such as a pandas UDF. Every operator on tokens takes one.
Tokenizer = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    """Word runs and single CJK characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """What stands between spaces."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def tokenize(text: str | Column, tokenizer: Tokenizer = word_tokens) -> Column:
    """Tokens of the cleaned text; by default word runs and single CJK characters.

    Emoji and whitespace are never part of such a token and always end one, so
    only URLs and tags have to be removed first. Another tokenizer gets the
    text as ``clean_text`` gives it; null tokens are dropped, and null is no tokens.
    """
    if tokenizer is word_tokens:
        return word_tokens(_without_markup(_column(text)))
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_compact(tokenizer(clean_text(text)).cast("array<string>")), none)


def content_words(text: str | Column) -> Column:
    """Lower-cased words for keyword trends, without link fragments."""
    words = F.regexp_extract_all(_column(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(
        F.transform(words, F.lower),
        lambda w: ~(w.startswith("http") | w.startswith("www")),
    )


def token_counts(tokens: Column) -> Column:
    """Distinct tokens of one row as ``array<struct<token, n, pos>>``.

    ``pos`` is the first position of the token. Sorting (token, position) puts
    equal tokens next to each other, so the counts are run lengths: n log n in
    the length of the text and no shuffle.
    """
    placed = F.sort_array(
        F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    )

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        token = lambda i: F.get(ordered, i)["token"]
        places = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
        starts = F.filter(places, lambda i: (i == 0) | (token(i - 1) != token(i)))
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda i, j: F.struct(
                    token(i).alias("token"),
                    (F.coalesce(F.get(s, j + 1), size) - i).alias("n"),
                    F.get(ordered, i)["pos"].alias("pos"),
                ),
            ),
        )

    return let(placed, runs)


def ranked_tokens(tokens: Column, top_n: int) -> Column:
    """The ``top_n`` most frequent tokens, earlier first on equal counts."""
    keyed = F.transform(
        token_counts(tokens),
        lambda x: F.struct((-x["n"]).alias("rank"), x["pos"].alias("pos"), x["token"].alias("token")),
    )
    return F.slice(F.sort_array(keyed), 1, max(1, int(top_n)))


def keywords(text: str | Column, top_n: int = 10, tokenizer: Tokenizer = word_tokens) -> Column:
    return F.transform(ranked_tokens(tokenize(text, tokenizer), top_n), lambda x: x["token"])


def entities(text: str | Column) -> Column:
    """Hashtags, then mentions, each once, in order of appearance."""
    source = _column(text)
    cleaned = clean_text(source)
    none = F.array().cast("array<string>")
    tags = F.when(F.contains(source, F.lit("#")), F.regexp_extract_all(cleaned, F.lit(HASHTAG_PATTERN), F.lit(1)))
    mentions = F.when(
        F.contains(source, F.lit("@")), F.regexp_extract_all(cleaned, F.lit(MENTION_PATTERN), F.lit(1))
    )
    return F.array_distinct(F.concat(F.coalesce(tags, none), F.coalesce(mentions, none)))


def _chinese_lexicon_words(text: Column) -> Column:
    """The Chinese lexicon words of a text where they occur, the longest first and none inside another.

    Chinese is written without spaces, so tokens of the text can't be compared.
    """
    words = sorted((w for w in (*POSITIVE_WORDS, *NEGATIVE_WORDS) if not w.isascii()), key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(_without_markup(text), F.lit("|".join(words)), F.lit(0))
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), found).otherwise(F.array().cast("array<string>"))


def lexicon_sentiment(text: str | Column, tokenizer: Tokenizer = word_tokens, tokens: Column | None = None) -> Column:
    """Lexicon score as ``struct<label, score, positive, negative>``; tokens that are known aren't made again."""

    def count(words: Column, chinese: Column, lexicon: tuple[str, ...]) -> Column:
        latin = F.size(F.filter(words, lambda t: t.isin(*[w for w in lexicon if w.isascii()])))
        return latin + F.size(F.filter(chinese, lambda t: t.isin(*[w for w in lexicon if not w.isascii()])))

    def score(found: Column) -> Column:
        pos = count(found["tokens"], found["chinese"], POSITIVE_WORDS)
        neg = count(found["tokens"], found["chinese"], NEGATIVE_WORDS)
        label = F.when(pos > neg, "positive").when(pos < neg, "negative").otherwise("neutral")
        return F.struct(
            label.alias("label"),
            (pos - neg).alias("score"),
            pos.alias("positive"),
            neg.alias("negative"),
        )

    source = _column(text)
    made = tokenize(text, tokenizer) if tokens is None else tokens
    return let(F.struct(made.alias("tokens"), _chinese_lexicon_words(source).alias("chinese")), score)


def repair_mojibake(text: str | Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; leave everything else alone."""
    c = F.col(text) if isinstance(text, str) else text
    decoded = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return F.when(c.rlike(r"^[\x00-\xFF]*$"), F.coalesce(decoded, c)).otherwise(c)
