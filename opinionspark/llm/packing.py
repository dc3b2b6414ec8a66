"""Best-fit packing by bin completion.

Documents become token pieces of at most ``size``. Only the number of pieces
of each length matters for the plan, and that histogram has at most ``size``
entries however many documents there are. The best-fit plan is the first
incumbent. If it needs more sequences than a lower bound, bin completion looks
for a plan with one less: the longest piece left opens a sequence, its
undominated fillings are the branches, and a branch is cut when the waste so far
exceeds what the plan may waste, or the rest's lower bound the sequences left.
Spark then deals the pieces to the planned places by their rank within their
length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_of, stored, text_or_empty
from .shingles import mixed, span_hashes, text_slices

SIZE = 2048
#: Id that ends each document.
END = 0
#: Steps of a whole search, after which the incumbent is kept; with None a search ends only with a proof.
STEPS = 1_000_000
#: Units whose ids a Python worker remembers, in each of two generations: 18 bytes each and their ids.
_REMEMBERED = 2_000_000
#: A tokenizer that cuts texts as ``units`` does: this normalizer and this splitting, and each piece for itself.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: white space, ASCII letters, digits, signs, the first byte of many Latin letters, all others.
_SPACE, _LETTER, _DIGIT, _SIGN, _LATIN, _ODD = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[ord("'")] = _ODD
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
for _first, _last, _kind in (("0", "9", _DIGIT), ("A", "Z", _LETTER), ("a", "z", _LETTER)):
    _KIND[ord(_first) : ord(_last) + 1] = _kind
_KIND[0xC3] = _LATIN
#: What the tokenizer's byte-level alphabet writes for each byte: printable ones stay, the others follow from 256 on.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SAME)}


def units(data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts, ends, whether plain) of what a tokenizer encodes piece by piece.

    Plain units are runs of Latin letters, single digits and runs of ASCII
    signs. A word in which there is anything else, or a byte of ``odd``, is one
    unit, in its own case and not plain.
    """
    n = len(data)
    kind = _KIND[data]
    kind[odd[data] & (kind != _SPACE)] = _ODD
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    first = np.flatnonzero(kind == _LATIN)
    if len(first):
        # The letters from U+00C0 to U+00FF, two bytes each; the two signs among them aren't letters.
        second = data[np.minimum(first + 1, n - 1)]
        letter = (first + 1 < n) & (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[first] = np.where(letter, _LETTER, _ODD)
        second_at = first[letter] + 1
        kind[second_at] = _LETTER
        capital = data[second_at] <= 0x9E
        lower[second_at[capital]] += 0x20
    inside = kind != _SPACE
    row_edge = np.zeros(n + 1, bool)
    row_edge[offsets] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _SPACE, kind[:-1]
    new_word = inside & ((before == _SPACE) | row_edge[:-1])
    word_starts = np.flatnonzero(new_word)
    if not len(word_starts):
        none = np.zeros(0, np.int64)
        return lower, none, none, np.zeros(0, bool)
    word_odd = np.maximum.reduceat(kind == _ODD, word_starts)
    odd_bytes = np.zeros(n, bool)
    which = np.cumsum(new_word) - 1
    odd_bytes[inside] = word_odd[which[inside]]
    starts_at = inside & (new_word | (~odd_bytes & ((kind != before) | (kind == _DIGIT))))
    starts = np.flatnonzero(starts_at)
    after = np.empty(n, bool)
    after[:-1], after[-1] = starts_at[1:] | ~inside[1:], True
    ends = np.flatnonzero(inside & (after | row_edge[1:])) + 1
    plain = ~odd_bytes[starts]
    lower[odd_bytes] = data[odd_bytes]
    return lower, starts, ends, plain


class _Ids:
    """Ids of units by the units' hashes: sorted keys, and of each the place and number of its ids."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Sorted new keys with their ids, one after the other."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.ids = np.concatenate((self.ids, ids))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, the ids one after the other) of the keys at ``at``."""
        count = self.count[at].astype(np.int64)
        place = np.arange(int(count.sum())) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
        return count, self.ids[place]


class UnitEncoder:
    """Token ids of many texts at once, from the ids of their units.

    A tokenizer that drops white space and encodes letters, digits and signs
    apart gives a text the ids of its units in order, and most units are
    remembered. Units are told apart by 64-bit hashes. What wasn't met for long is
    forgotten: a full generation replaces the one before. Whether the tokenizer
    is such a one is read from its own settings; the texts of any other are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self._tokenizer.to_str())
        added = [t["content"] for t in settings.get("added_tokens") or []]
        self.by_units = self._splits_alike(settings) and not any(c.isspace() for t in added for c in t)
        self._odd = np.zeros(256, bool)
        self._odd[[t.encode()[0] for t in added]] = True
        self._young, self._old = _Ids(), _Ids()

    @staticmethod
    def _splits_alike(settings: dict) -> bool:
        normalizers = (settings.get("normalizer") or {}).get("normalizers") or []
        steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
        model = settings.get("model") or {}
        return (
            [x.get("type") for x in normalizers] == _NORMALIZERS
            and (normalizers[1].get("pattern"), normalizers[1].get("content")) == ({"Regex": r"\s+"}, " ")
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": _SPLIT}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and settings.get("truncation") is None
        )

    def whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, unit: bytes, plain: bool) -> list[int]:
        if not plain:
            return self.whole(unit.decode())
        return [t.id for t in self._tokenizer.model.tokenize(unit.decode("latin-1").translate(_ALPHABET))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and, last, their number)."""
        if not self.by_units:
            rows = [self.whole(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.array([i for r in rows for i in r], "<u4"), np.cumsum([0] + [len(r) for r in rows])
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        lower, starts, ends, plain = units(data, offsets, self._odd)
        hashes = span_hashes(lower, starts, ends)
        hashes[~plain] = mixed(hashes[~plain] + np.uint64(1))
        keys, sample, index = np.unique(hashes, return_index=True, return_inverse=True)
        _, known = self._young.find(keys)
        new = np.flatnonzero(~known)
        at, old = self._old.find(keys[new])
        count, ids = np.zeros(len(new), np.int64), []
        kept, kept_ids = self._old.of(at[old])
        count[old] = kept
        edges = np.concatenate(([0], np.cumsum(kept)))
        met = 0
        for i, (k, was) in enumerate(zip(sample[new].tolist(), old.tolist())):
            if was:
                ids.append(kept_ids[edges[met] : edges[met + 1]])
                met += 1
            else:
                found = self._encoded(lower[starts[k] : ends[k]].tobytes(), bool(plain[k]))
                count[i] = len(found)
                ids.append(found)
        if len(new):
            self._young.add(keys[new], count, np.fromiter(chain.from_iterable(ids), "<u4", int(count.sum())))
        at, _ = self._young.find(keys)
        per_unit, out = self._young.of(at[index])
        rows = np.concatenate(([0], np.cumsum(per_unit)))[np.searchsorted(starts, offsets)]
        if len(self._young.keys) > _REMEMBERED:
            self._old, self._young = self._young, _Ids()
        return out, rows


@functools.lru_cache(maxsize=1)
def unit_encoder(path: str) -> UnitEncoder:
    """The Python worker's encoder, whose memory of units serves all its tasks."""
    return UnitEncoder(path)


#: Lengths of the pieces of one sequence, and how many such sequences there are.
Plan = list[tuple[list[int], int]]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place), stored.

    ``place`` counts the pieces of one length within the task that made them,
    ``part`` names that task's partition.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = unit_encoder(tokenizer), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in parts_of(batches):
            for first, end, data, offsets in text_slices(batch["text"]):
                yield pieces_of(batch["doc_id"].slice(first, end - first), *encoder.encode(data, offsets), seen, part)

    def pieces_of(doc_ids: pa.Array, ids: np.ndarray, rows: np.ndarray, seen: np.ndarray, part: int) -> pa.RecordBatch:
        total = np.diff(rows) + 1
        per_row = -(-total // size)
        row = np.repeat(np.arange(len(total)), per_row)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = piece * size
        length = np.minimum(size, total[row] - start)
        # The end id follows a row's own ids.
        ended = np.insert(ids, rows[1:], END).astype("<u4")
        begin = (np.cumsum(total) - total)[row] + start
        raw = ended.tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
        # Pieces of one length are counted in order.
        order = np.argsort(length, kind="stable")
        sorted_ = length[order]
        head = np.searchsorted(sorted_, sorted_)
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(length)) - head + seen[sorted_]
        seen += np.bincount(length, minlength=size + 1)
        columns = [piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(row), part), place]
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), *[pa.array(c) for c in columns]], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
    return stored(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, _PIECES), "pieces")


def _best_fit(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The filling that takes the longest piece that fits, again and again."""
    filling: list[int] = []
    k = bisect.bisect_right(lengths, room)
    while k:
        length = lengths[k - 1]
        n = min(counts[length], room // length)
        filling += [length] * n
        room -= n * length
        k = min(k - 1, bisect.bisect_right(lengths, room))
    return filling


def best_fit_plan(histogram: dict[int, int], size: int) -> Plan:
    """Each sequence is the longest piece left and what fits best; it is repeated until a length runs short."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts)
    plan = []
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        filling = _best_fit(lengths if counts[longest] else lengths[:-1], counts, size - longest)
        counts[longest] += 1
        sequence = [longest, *filling]
        used = {n: sequence.count(n) for n in set(sequence)}
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        plan.append((sequence, times))
    return plan


def least_sequences(counts: np.ndarray, size: int) -> int:
    """A lower bound: counts[n] pieces of length n.

    For a threshold k, pieces above size - k and above half of size are alone
    with others of theirs; pieces from k up to half of it fill what the latter
    leave open and then sequences of their own. k = 0 gives the sum's bound.
    """
    n = np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(counts * np.arange(size + 1))))
    half = size // 2
    k = np.arange(half + 1)
    above = n[size + 1] - n[half + 1]
    large = n[size - k + 1] - n[half + 1]
    room = large * size - (total[size - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int((above + np.maximum(0, -((room - small) // size))).max())


class _Spent(Exception):
    """A search has used up its steps."""


class Completion:
    """Bin completion: is there a plan of a given number of sequences?"""

    def __init__(self, size: int, steps: int | None):
        self._size, self.steps, self._spent = size, steps, 0

    def _step(self) -> None:
        self._spent += 1
        if self.steps is not None and self._spent > self.steps:
            raise _Spent

    def fillings(self, counts: np.ndarray, room: int, waste: int) -> Iterator[list[int]]:
        """The undominated fillings of ``room`` that leave at most ``waste`` open, least waste first in growing lots."""
        lot: list[tuple[int, list[int]]] = []
        most = 8
        for left, filling in self._every_filling(counts, room, waste):
            lot.append((left, filling))
            if len(lot) == most:
                yield from (f for _, f in sorted(lot, key=lambda x: x[0]))
                lot, most = [], 2 * most
        yield from (f for _, f in sorted(lot, key=lambda x: x[0]))

    def _every_filling(self, counts: np.ndarray, room: int, waste: int) -> Iterator[tuple[int, list[int]]]:
        lengths = np.flatnonzero(counts[: room + 1]).tolist()
        have = [int(counts[n]) for n in lengths]
        shorter = list(accumulate((n * c for n, c in zip(lengths, have)), initial=0))
        spare = sum(1 << n for n in lengths)
        # (lengths below which may be taken, room left, filling as a linked list)
        stack: list[tuple[int, int, tuple | None]] = [(len(lengths), room, None)]
        while stack:
            self._step()
            top, left, filling = stack.pop()
            k = min(top, bisect.bisect_right(lengths, left))
            if left - shorter[k] > waste:
                continue
            if k == 0:
                listed = _listed(filling)
                if not self._dominated(listed, left, spare, counts):
                    yield left, listed
                continue
            length = lengths[k - 1]
            for n in range(min(have[k - 1], left // length) + 1):
                stack.append((k - 1, left - n * length, (length, n, filling) if n else filling))

    @staticmethod
    def _dominated(filling: list[int], left: int, spare: int, counts: np.ndarray) -> bool:
        """Whether a piece outside could stand in for some inside, or for none, filling as much or more.

        Then the pieces could change places, so the filling with that piece is
        as good in any plan. Equal sums count only against two pieces or more.
        Sums are bits of a number.
        """
        for n in set(filling):
            if filling.count(n) == counts[n]:
                spare &= ~(1 << n)
        any_, several = 0, 0
        for n in filling:
            several |= any_ << n
            any_ |= (any_ << n) | (1 << n)
        # Sums, or nothing, raised by 1 to ``left``.
        better, width = (any_ | 1) << 1 if left else 0, 1
        while width < left:
            step = min(width, left - width)
            better |= better << step
            width += step
        return bool((better | several) & spare)

    def plan(self, counts: np.ndarray, sequences: int) -> Plan | None:
        """A plan of at most so many sequences, or None if there is none; raises when the steps are used up."""
        # What is left, by a digest, and the sequences into which it doesn't fit.
        failed: dict[bytes, int] = {}
        path: list[tuple[list[int], int, Iterator[tuple[list[int], int]]]] = []
        left = sequences
        choices = self._choices(counts, left, failed)
        while True:
            if choices is None:
                return [(sequence, times) for sequence, times, _ in path]
            chosen = next(choices, None)
            if chosen is None:
                failed[_seal(counts)] = left
                if not path:
                    return None
                sequence, times, choices = path.pop()
                counts, left = counts.copy(), left + times
                np.add.at(counts, sequence, times)
                continue
            sequence, times = chosen
            path.append((sequence, times, choices))
            counts, left = counts.copy(), left - times
            np.subtract.at(counts, sequence, times)
            choices = self._choices(counts, left, failed)

    def _choices(self, counts: np.ndarray, left: int, failed: dict[bytes, int]) -> Iterator[tuple[list[int], int]] | None:
        """(sequence, how often) to go on with, none if the rest cannot fit into ``left`` sequences; None when all is placed."""
        some = np.flatnonzero(counts)
        if not len(some):
            return None
        waste = left * self._size - int((some * counts[some]).sum())
        if waste < 0 or failed.get(_seal(counts), -1) >= left or least_sequences(counts, self._size) > left:
            return iter(())
        return self._completions(counts, int(some[-1]), waste)

    def _completions(self, counts: np.ndarray, longest: int, waste: int) -> Iterator[tuple[list[int], int]]:
        rest = counts.copy()
        rest[longest] -= 1
        once = []
        for filling in self.fillings(rest, self._size - longest, waste):
            sequence = [longest, *filling]
            times = min(int(counts[n]) // sequence.count(n) for n in set(sequence))
            own = self._size - sum(sequence)
            times = min(times, waste // own) if own else times
            yield sequence, times
            if times > 1:
                once.append(sequence)
        # Any other plan repeats a sequence less often; it is made of single ones.
        yield from ((sequence, 1) for sequence in once)


def _seal(counts: np.ndarray) -> bytes:
    return hashlib.blake2b(counts.tobytes(), digest_size=16).digest()


def _listed(filling: tuple | None) -> list[int]:
    out: list[int] = []
    while filling:
        length, n, filling = filling
        out += [length] * n
    return sorted(out, reverse=True)


def plan_sequences(histogram: dict[int, int], size: int = SIZE, steps: int | None = STEPS) -> Plan:
    """[(lengths of one sequence, how many such sequences)], using every piece once, as few sequences as there can be.

    A best-fit plan that needs no more sequences than the lower bound is
    returned without a search. Otherwise plans of one sequence less are searched
    until there is none or ``steps`` are used up, which ends the search at the
    best plan so far; with None it always ends with a proof.
    """
    counts = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    best = best_fit_plan(histogram, size)
    needed = sum(times for _, times in best)
    search = Completion(size, steps)
    try:
        while needed > least_sequences(counts, size):
            found = search.plan(counts, needed - 1)
            if found is None:
                break
            best, needed = found, sum(times for _, times in found)
    except _Spent:
        pass
    return best


def _places(plan: Plan) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, per sequence, first sequence, first offset) in the order of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            rows.setdefault(n, []).append((rank.get(n, 0), k, sequence, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, steps: int | None = STEPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a place for every piece.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty
    text is one piece, the end id. A repeated row is packed again, a null
    doc_id stays null, and no documents give no rows. A text of any length is
    encoded whole and cut into pieces of ``size``. ``tokenizer`` is the path of a
    tokenizer file that executors can read. ``steps`` bounds the search for a
    plan with fewer sequences than best fit needs, on the driver; None is no bound.
    """
    pieces = token_pieces(docs, tokenizer, size)
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        per_part.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "parts"
    )
    # At most ``size`` rows.
    histogram = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_sequences(histogram, size, steps))
    dealt = pieces.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = dealt.value
        for batch in batches:
            rank = batch["before"].to_numpy() + batch["place"].to_numpy()
            length = batch["length"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = of[n]
                first, per, base, start = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1].T
                sequence[at] = base + (rank[at] - first) // per
                offset[at] = start + (rank[at] - first) % per * n
            kept = [batch[c] for c in columns[:5]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], [*columns[:5], "sequence_id", "offset"]
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "before", "place"]
    ranked = pieces.join(offsets.select("length", "part", "before"), ["length", "part"])
    return ranked.select(*columns).mapInArrow(place, _PLACED)
