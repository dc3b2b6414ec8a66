"""Words of Chinese text by a dictionary: the most probable path through each run of characters.

Chinese is written without spaces. Of all ways to cut a run into words of the
dictionary the one with the highest product of word frequencies is taken. A
place where no word begins is a word of one character that was seen once. Costs
are whole numbers, so that sums are exact and ties always fall alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Tokenizer
from .values import let

#: The dictionary goes to every executor, so it may have so many words of at most so many characters.
MOST_WORDS, LONGEST_WORD = 1_000_000, 32
#: Costs are in so small parts of a unit of the natural logarithm.
PARTS = 1_000_000
#: Runs of at most so many characters are cut together, so many characters at once.
SHORT_RUN, TOGETHER = 200, 200_000
_RUNS = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]+"
_CHINESE = r"[\x{4e00}-\x{9fff}]"


class Dictionary:
    """Words with their costs, and all their beginnings."""

    def __init__(self, words: dict[str, int]):
        total = sum(words.values()) or 1
        self.unknown = round(PARTS * math.log(total))
        self.costs = {w: round(PARTS * (math.log(total) - math.log(n))) for w, n in words.items()}
        self.beginnings = {w[:k] for w in words for k in range(1, len(w) + 1)}
        # The same as arrays: from the number of a beginning and a character to the number of the longer beginning.
        names = sorted(self.beginnings)
        number = {"": 0} | {name: k for k, name in enumerate(names, 1)}
        key = np.array([number[name[:-1]] << 21 | ord(name[-1]) for name in names], np.int64)
        order = np.argsort(key)
        self._steps, self._reached = key[order], (order + 1).astype(np.int32)
        self._prices = np.array([-1, *(self.costs.get(name, -1) for name in names)], np.int64)

    def words_at(self, run: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, cost) of the words that begin at ``start``, the shortest first."""
        found = False
        for end in range(start + 1, len(run) + 1):
            word = run[start:end]
            if word not in self.beginnings:
                break
            cost = self.costs.get(word)
            if cost is not None:
                found = True
                yield end, cost
        if not found:
            yield start + 1, self.unknown

    def cut(self, run: str) -> list[str]:
        """The words of a run; of equally probable ways the one with the longer word first."""
        best, chosen = [0] * (len(run) + 1), [0] * len(run)
        for start in range(len(run) - 1, -1, -1):
            best[start], end = min((cost + best[end], -end) for end, cost in self.words_at(run, start))
            chosen[start] = -end
        out, start = [], 0
        while start < len(run):
            out.append(run[start : chosen[start]])
            start = chosen[start]
        return out

    def cut_all(self, runs: list[str]) -> list[str]:
        """The words of each run joined by line ends, as ``cut`` finds them; short runs are cut together."""
        out = [""] * len(runs)
        few, size = [], 0
        for k, run in enumerate(runs):
            if len(run) > SHORT_RUN:
                out[k] = "\n".join(self.cut(run))
                continue
            few.append(k)
            size += len(run) + 1
            if size >= TOGETHER:
                self._cut_into(out, runs, few)
                few, size = [], 0
        if few:
            self._cut_into(out, runs, few)
        return out

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, cost) of the words that may be taken; character 0 ends a run."""
        starts, found = np.flatnonzero(text), []
        inside, wordless = starts, np.ones(len(text), bool)
        state, length = np.zeros(len(starts), np.int64), 0
        while len(starts) and len(self._steps):
            key = state << 21 | text[starts + length]
            at = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            known = self._steps[at] == key
            starts, state, length = starts[known], self._reached[at[known]].astype(np.int64), length + 1
            price = self._prices[state]
            words = price >= 0
            wordless[starts[words]] = False
            found.append((starts[words], np.full(int(words.sum()), length), price[words]))
        rest = inside[wordless[inside]]
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), self.unknown, np.int64)))
        return tuple(np.concatenate(part) for part in zip(*found))

    def _cut_into(self, out: list[str], runs: list[str], chosen: list[int]) -> None:
        """Fills in the runs at the chosen places, all from their ends to their beginnings at the same time."""
        text = np.frombuffer("\0".join([*(runs[k] for k in chosen), ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.flatnonzero(text == 0)
        left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(text))
        start, length, cost = self._edges(text)
        order = np.argsort(left[start] * len(text) + start)
        start, length, cost = start[order], length[order], cost[order]
        first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]][: len(start)])
        # Of equal costs the longer word has the smaller number.
        best, taken, unit = np.zeros(len(text), np.int64), np.ones(len(text), np.int64), int(length.max(initial=0)) + 1
        own = start[first]
        steps = np.searchsorted(left[own], np.arange(1, int(left.max(initial=0)) + 2))
        after = np.r_[first, len(start)]
        for low, high in zip(steps[:-1], steps[1:]):
            some = slice(after[low], after[high])
            value = (cost[some] + best[start[some] + length[some]]) * unit + (unit - 1 - length[some])
            least = np.minimum.reduceat(value, first[low:high] - after[low])
            best[own[low:high]], taken[own[low:high]] = least // unit, unit - 1 - least % unit
        begins, at = np.zeros(len(text), bool), np.r_[0, ends[:-1] + 1]
        while len(at := at[text[at] != 0]):
            at = at + taken[at]
            begins[at] = True
        begins &= text != 0
        made = np.insert(text, np.flatnonzero(begins), ord("\n")).astype(np.uint32).tobytes().decode("utf-32-le")
        for k, words in zip(chosen, made.split("\0")):
            out[k] = words


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a text file with a word, its frequency and more on each line; without a number it is 1."""
    parts = F.split(F.trim("value"), r"\s+")
    freq = F.greatest(F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(1)), F.lit(1))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), freq.alias("freq")).filter("word <> ''")


def dictionary_of(words: DataFrame) -> Dictionary:
    """The Chinese words of (word, freq), of repeated ones the highest frequency. Its size is checked before it is sent."""
    usable = words.filter(F.col("word").rlike(rf"^{_CHINESE}{{1,{LONGEST_WORD}}}$") & (F.col("freq") > 0))
    rows = usable.groupBy("word").agg(F.max("freq").alias("freq")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
    return Dictionary({r.word: r.freq for r in rows})


def dictionary_tokenizer(words: DataFrame) -> Tokenizer:
    """A tokenizer that cuts runs of Chinese characters by the dictionary (word, freq); other tokens are word runs.

    Only texts with Chinese in them go to Python, in batches, and a batch cuts each of its distinct runs once.
    """
    shared = words.sparkSession.sparkContext.broadcast(dictionary_of(words))

    @F.pandas_udf("string")
    def cut(runs: pd.Series) -> pd.Series:
        texts = [None if text is None else text.split("\n") for text in runs]
        chinese = list({run for text in texts if text for run in text if run[:1] >= "一"})
        known = dict(zip(chinese, shared.value.cut_all(chinese)))
        return pd.Series([None if text is None else "\n".join([known.get(run, run) for run in text]) for text in texts], dtype=object)

    def tokens(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))
        # The text is an expression of its own, so it stands here once.
        chinese = let(runs, lambda r: F.when(F.exists(r, lambda run: run >= "一"), F.array_join(r, "\n")))
        return F.coalesce(F.split(cut(chinese), "\n"), runs)

    return tokens
