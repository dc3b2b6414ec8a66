"""Removing long strings that earlier documents have, by suffix arrays.

Equal strings must meet before they can be sorted side by side. Each 50-byte
string is dealt by its anchor, the 18-byte piece in it with the least hash, so
equal strings have equal anchors. First only anchors' hashes are compared, and
text whose anchors occur in one document only goes no further. The rest is cut
into regions, runs of strings with one anchor, which are dealt by anchor. In
each task the regions' suffix array is built by the difference cover algorithm:
sampled triples are sorted and named, the names are solved recursively, the
remaining suffixes are merged in, and prefixes of neighbours are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bundles import grown, shrunk
from ..plans.checkpoints import release_shuffles
from .common import parts_of, release_memory, stored, text_or_empty
from .shingles import mixed, text_slices

LENGTH, GRAM = 50, 18
#: Anchors that occur more often have their strings dealt one by one, by their own hash.
OFTEN = 4096
#: Text that is sorted together in a task.
_CHUNK = 1 << 19
_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(50)).integers(1, 2**63, 256, dtype=np.uint64)
#: Stands for a null doc_id: later than all others, and alike with this very id.
_LAST = 2**63 - 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes from each position on, built by doubling."""
    base, hashes, length = _U(0x9E3779B97F4A7C15), _BYTE[data], 1
    while length * 2 <= size:
        hashes = hashes[:-length] * base + hashes[length:]
        base, length = base * base, length * 2
    if length < size:
        n = len(data) - size + 1
        hashes = hashes[:n] * _U(0xD6E8FEB86659FD93) + hashes[size - length : size - length + n]
    return mixed(hashes)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    length = 1
    n = len(values) - width + 1
    while length * 2 <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[:n], values[width - length : width - length + n]) if length < width else values


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, row, first start, number of starts) of the runs of 50-byte strings with one anchor, in order."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    with np.errstate(over="ignore"):
        least = _sliding_least(gram_hashes(data, GRAM), LENGTH - GRAM + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[LENGTH - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
    at = np.flatnonzero(new & whole)
    # A run ends where another begins or where strings would leave the row.
    ends = np.append(np.flatnonzero(new), n)
    end = ends[np.searchsorted(ends, at, side="right")]
    end = np.minimum(end, offsets[row[at] + 1] - LENGTH + 1)
    return least[at], row[at], at - offsets[row[at]], end - at


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One number per row that sorts as the columns of non-negative numbers do."""
    out = columns[0].astype(np.int64)
    top = int(out.max(initial=0)) + 1
    for column in columns[1:]:
        more = int(column.max(initial=0)) + 1
        if top * more >= 2**63:
            values, out = np.unique(out, return_inverse=True)
            top = len(values)
        out = out * more + column
        top *= more
    return out


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks that sort the suffixes of ``text`` by at least their first ``depth`` symbols.

    Symbols are positive. Suffixes that agree that far have neighbouring or
    equal ranks. Difference cover {1, 2} modulo 3.
    """
    n = len(text)
    if n < 4:
        return _small(text)
    t = np.concatenate((text.astype(np.int64), np.zeros(4, np.int64)))
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    sample = np.concatenate((ones, twos))
    values, names = np.unique(_codes(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)
    names = names + 1
    if len(values) < len(sample) and depth > 3:
        string = np.concatenate((names[: len(ones)] + 1, [1], names[len(ones) :] + 1))
        ranks = suffix_ranks(string, -(-depth // 3))
        names = np.concatenate((ranks[: len(ones)], ranks[len(ones) + 1 :])) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    at = np.arange(n)
    zeros = np.arange(0, n, 3)
    by_one = _codes(t[:n], rank[1 : n + 1])
    by_two = _codes(t[:n], t[1 : n + 1], rank[2 : n + 2])
    zeros = zeros[np.lexsort((by_two[zeros], by_one[zeros]))]
    ones, twos = ones[ones < n], twos[twos < n]
    sample = np.concatenate((ones, twos))
    sample = sample[np.argsort(rank[sample], kind="stable")]
    is_one = sample % 3 == 1
    less = np.where(
        is_one,
        np.searchsorted(by_one[zeros], by_one[sample]),
        np.searchsorted(by_two[zeros], by_two[sample]),
    )
    first, second = sample[is_one], sample[~is_one]
    out = np.empty(n, np.int64)
    out[sample] = np.arange(len(sample)) + less
    out[zeros] = (
        np.arange(len(zeros))
        + np.searchsorted(by_one[first], by_one[zeros], side="right")
        + np.searchsorted(by_two[second], by_two[zeros], side="right")
    )
    return out[at]


def _small(text: np.ndarray) -> np.ndarray:
    order = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
    return np.argsort(np.array(order, dtype=np.int64))


def first_owners(regions: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string start of each region the least owner of a region that has the string; regions are distinct."""
    sizes = np.array([len(r) for r in regions])
    text = np.frombuffer(b"\0".join(regions), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    starts = sizes - length + 1
    region = np.repeat(np.arange(len(regions)), starts)
    place = np.arange(len(region)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin[region] + place
    order = np.argsort(suffix_ranks(text.astype(np.int64) + 1, length)[at], kind="stable")
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    differs = np.ones(len(at), bool)
    for start in range(1, len(at), 1 << 16):
        near = windows[at[order[start - 1 : start + (1 << 16)]]]
        differs[start : start + len(near) - 1] = (near[1:] != near[:-1]).any(axis=1)
    group = np.flatnonzero(differs)
    least = np.minimum.reduceat(owners[region[order]], group)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(group, len(at))))
    return np.split(out, np.cumsum(starts)[:-1])


def _deal(bucket: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _bucket(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (anchors >> _U(32)) % _U(buckets)


def _keys(anchors: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """What tells anchors apart: the lower half of each, after its bucket. Where keys collide, more text is sorted, no less."""
    return np.asarray(bucket, np.uint64) << _U(32) | anchors & _U(0xFFFFFFFF)


def anchor_table(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, idents, counts, anchors): the lower halves of each text's anchors, packed per batch and bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            ident = batch["ident"].to_numpy()
            found = [(a, ident[first + row]) for first, _, d, o in text_slices(batch["text"], 1 << 19) for a, row, _, _ in [anchor_runs(d, o)]]
            if not found:
                continue
            anchors, owner = (np.concatenate(x) for x in zip(*found))
            rows = []
            for b, at in _deal(_bucket(anchors, buckets), buckets):
                own = owner[at]
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, int)
                counts = np.diff(np.append(edge, len(own))).astype(np.uint32)
                rows.append((b, own[edge].tobytes(), counts.tobytes(), anchors[at].astype(np.uint32).tobytes()))
            yield _batch(rows, ["bucket", "idents", "counts", "anchors"], [pa.int32(), *[pa.binary()] * 3])

    return docs.select("ident", "text").mapInArrow(pack, "bucket int, idents binary, counts binary, anchors binary")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _by_slot(ids: np.ndarray, columns: dict[str, np.ndarray], slots: int) -> pd.DataFrame:
    """(slot, ids, counts, and the columns): values of ids, packed into a row for each slot that ids are dealt to."""
    slot = (mixed(ids.view(np.uint64)) % _U(slots)).astype(np.int64)
    order = np.lexsort((ids, slot))
    ids, slot, columns = ids[order], slot[order], {k: c[order] for k, c in columns.items()}
    rows = []
    for a, b in _runs(slot):
        own = ids[a:b]
        edge = np.array([x for x, _ in _runs(own)])
        counts = np.diff(np.append(edge, len(own))).astype(np.uint32)
        rows.append((slot[a], own[edge].tobytes(), counts.tobytes(), *[c[a:b].tobytes() for c in columns.values()]))
    return pd.DataFrame(rows, columns=["slot", "ids", "counts", *columns])


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of equal values."""
    if not len(values):
        return []
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))).tolist()
    return list(zip(edge, [*edge[1:], len(values)]))


def _unpacked(group: pd.DataFrame, ids: str = "ids") -> np.ndarray:
    return np.concatenate(
        [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32)) for i, c in zip(group[ids], group["counts"])]
    )


def _gathered(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(id, and the columns): the values of each id from all packed rows of its slot."""

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        ids = _unpacked(group)
        order = np.argsort(ids, kind="stable")
        values = {c: np.frombuffer(b"".join(group[c]), kind)[order] for c, kind in columns.items()}
        runs = _runs(ids[order])
        out = {"id": ids[order][[a for a, _ in runs]]} | {c: [v[a:b].tobytes() for a, b in runs] for c, v in values.items()}
        return pd.DataFrame(out)

    schema = ", ".join(["id long", *[f"{c} binary" for c in columns]])
    return rows.groupBy("slot").applyInPandas(gather, schema)


def _shared(group: pd.DataFrame, most: int, slots: int) -> pd.DataFrame:
    """The keys of anchors that several texts have and whether each is frequent, for each text, packed by slot."""
    ident = _unpacked(group, "idents")
    halves = np.frombuffer(b"".join(group["anchors"]), np.uint32)
    anchors = _keys(halves.astype(np.uint64), int(group["bucket"].iloc[0]))
    order = np.argsort(anchors, kind="stable")
    anchors, ident = anchors[order], ident[order]
    edge = np.array([a for a, _ in _runs(anchors)])
    times = np.diff(np.append(edge, len(anchors)))
    several = np.minimum.reduceat(ident, edge) != np.maximum.reduceat(ident, edge)
    keep = np.repeat(several, times)
    often = np.repeat(times > most, times)
    release_memory()
    return _by_slot(ident[keep], {"anchors": anchors[keep], "often": often[keep]}, slots)


def region_table(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, idents, places, sizes, anchors, bytes): the regions of texts (id, ident, text, anchors, often), compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            ids = list(zip(batch["id"].to_pylist(), batch["ident"].to_pylist()))
            shared, often = batch["anchors"].to_pylist(), batch["often"].to_pylist()
            parts = []
            for first, end, data, offsets in text_slices(batch["text"], 1 << 19):
                anchor, row, place, count = anchor_runs(data, offsets)
                edges = np.searchsorted(row, np.arange(end - first + 1))
                for k in range(end - first):
                    own = slice(edges[k], edges[k + 1])
                    wanted = np.frombuffer(shared[first + k], np.uint64)
                    order = np.argsort(wanted)
                    frequent = np.frombuffer(often[first + k], bool)[order]
                    wanted = wanted[order]
                    if not len(wanted):
                        continue
                    keys = _keys(anchor[own], _bucket(anchor[own], buckets))
                    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    hit = wanted[at] == keys
                    text = data[offsets[k] : offsets[k + 1]]
                    single = hit & frequent[at]
                    run = hit & ~single
                    parts.append((ids[first + k], text, anchor[own][run], place[own][run], count[own][run]))
                    if single.any():
                        starts = np.concatenate([np.arange(p, p + c) for p, c in zip(place[own][single], count[own][single])])
                        with np.errstate(over="ignore"):
                            own_hash = gram_hashes(text, LENGTH)[starts]
                        parts.append((ids[first + k], text, own_hash, starts, np.ones(len(starts), np.int64)))
            yield from _packed_regions(parts, buckets)

    schema = "bucket int, ids binary, idents binary, places binary, sizes binary, anchors binary, bytes binary"
    return texts.select("id", "ident", "text", "anchors", "often").mapInArrow(cut, schema)


def _packed_regions(parts: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "ids", "idents", "places", "sizes", "anchors", "bytes"]
    if not parts:
        return
    owner = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
    anchor, place, count = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    ids, idents = np.array([p[0] for p in parts], dtype=np.int64).T
    rows = []
    for b, at in _deal(_bucket(anchor, buckets), buckets):
        size = count[at] + LENGTH - 1
        text = np.concatenate([parts[o][1][s : s + n] for o, s, n in zip(owner[at].tolist(), place[at].tolist(), size.tolist())])
        numbers = (ids[owner[at]], idents[owner[at]], place[at], size, anchor[at].astype(np.uint32))
        rows.append((b, *[shrunk(x) for x in (*numbers, text)]))
    yield _batch(rows, names, [pa.int32(), *[pa.binary()] * 6])


def _covered(group: pd.DataFrame, slots: int) -> pd.DataFrame:
    """The bytes of each document that strings of earlier documents cover, from one bucket's regions, packed by slot."""
    columns = ("ids", "idents", "places", "sizes")
    ids, ident, place, size = (np.concatenate([grown(x, "int64") for x in group[c]]) for c in columns)
    anchor = np.concatenate([grown(x, "uint32") for x in group["anchors"]])
    raw = b"".join([grown(x, "uint8").tobytes() for x in group["bytes"]])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    order = np.argsort(anchor, kind="stable")
    # Chunks of about _CHUNK bytes that keep an anchor's regions together.
    same = np.concatenate(([False], anchor[order][1:] == anchor[order][:-1]))
    total = np.cumsum(size[order])
    out_id, out_from, out_to = [], [], []
    start = 0
    while start < len(order):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + _CHUNK, side="right"))
        end = max(end, start + 1)
        while end < len(order) and same[end]:
            end += 1
        own = order[start:end]
        start = end
        _cover_chunk(raw, *[x[own] for x in (anchor, ids, ident, place, size, begin)], (out_id, out_from, out_to))
    release_memory()
    spans = np.stack((np.concatenate(out_from), np.concatenate(out_to)), axis=1)
    return _by_slot(np.concatenate(out_id), {"spans": spans}, slots)


def _cover_chunk(raw, anchor, ids, ident, place, size, begin, out) -> None:
    known: dict[bytes, int] = {}
    which = np.empty(len(ids), np.int64)
    for k, (b, n) in enumerate(zip(begin.tolist(), size.tolist())):
        which[k] = known.setdefault(raw[b : b + n], len(known))
    owners = np.full(len(known), _LAST)
    np.minimum.at(owners, which, ids)
    later = ids > owners[which]
    for column, values in zip(out, (ident[later], place[later], place[later] + size[later])):
        column.append(values)
    # The region's first owner: only strings that a still earlier document has. Where all regions of an anchor are
    # equal, none has. Equal regions have one anchor.
    anchor_of = np.empty(len(known), anchor.dtype)
    anchor_of[which] = anchor
    _, group, times = np.unique(anchor_of, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[group] > 1)
    if not len(met):
        return
    regions = list(known)
    first = dict(zip(met.tolist(), first_owners([regions[k] for k in met], owners[met])))
    changed = np.zeros(len(known), bool)
    changed[[k for k, f in first.items() if (f < owners[k]).any()]] = True
    for k in np.flatnonzero(~later & changed[which]):
        hit = np.flatnonzero(first[which[k]] < owners[which[k]])
        edge = np.flatnonzero(np.concatenate(([True], np.diff(hit) > 1)))
        low, high = hit[edge], hit[np.append(edge[1:], len(hit)) - 1] + LENGTH
        out[0].append(np.full(len(low), ident[k]))
        out[1].append(place[k] + low)
        out[2].append(place[k] + high)


def _kept(text: bytes, spans: bytes | None, copy: bool) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs of a text and what is left of it."""
    if copy:
        return ([(0, len(text))], b"") if len(text) >= LENGTH else ([], text)
    if not spans:
        return [], text
    all_ = np.frombuffer(spans, np.int64).reshape(-1, 2)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(all_[:, 1])
    new = np.concatenate(([True], all_[1:, 0] > reach[:-1]))
    low, high = all_[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(reach)) - 1]
    edges = np.concatenate(([0], np.stack((low, high), 1).ravel(), [len(text)])).tolist()
    return list(zip(low.tolist(), high.tolist())), b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _ident(digest: Column) -> Column:
    """60 bits of a digest, as a number that stands for a text."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _shared_anchors(texts: DataFrame, owners: DataFrame, often: int, buckets: int) -> DataFrame:
    """(id, digest, ident, anchors, often): the anchors of each distinct text (ident, text) that others share, stored."""
    slot = "slot long, ids binary, counts binary"
    shared = anchor_table(texts, buckets).groupBy("bucket").applyInPandas(
        lambda g: _shared(g, often, buckets), f"{slot}, anchors binary, often binary"
    )
    lists = _gathered(shared, {"anchors": "u8", "often": "?"}).withColumnRenamed("id", "ident")
    return stored(
        lists.join(owners, "ident").select(F.col("rep").alias("id"), "digest", "ident", "anchors", "often"), "anchors"
    )


def _spans(texts: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """(ident, found): the spans of each text (id, digest, text) that strings of earlier documents cover, stored."""
    once = texts.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"])
    covered = region_table(once, buckets).groupBy("bucket").applyInPandas(
        lambda g: _covered(g, buckets), "slot long, ids binary, counts binary, spans binary"
    )
    return stored(_gathered(covered, {"spans": "i8, i8"}).select(F.col("id").alias("ident"), F.col("spans").alias("found")), "spans")


def dedup_substrings(docs: DataFrame, *columns: str, often: int = OFTEN) -> DataFrame:
    """(id, digest, text, row, copy, found): each text, with ``columns`` in row, and the spans that strings of earlier documents cover.

    A text is its UTF-8 bytes; a null text is empty. Every byte goes that lies
    in a 50-byte string which also starts in a document with a smaller doc_id.
    A ``copy`` of an earlier text goes whole; ``found`` are packed, unmerged
    spans [from, to). A null doc_id counts as larger than all others. Documents
    with one id, or without, keep what they have in common. Texts under 50
    bytes stay whole, repeated rows are judged alike, no documents give no
    rows, and other columns are ignored.

    Of equal texts only that with the smallest id is searched: the others go
    whole. Strings of anchors that occur more than ``often`` times are dealt one by one.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty()
    rows = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("id"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        text.alias("text"),
        F.struct("doc_id", *columns).alias("row"),
    )
    ids = stored(rows.select("id", "digest"), "ids")
    ident = _ident(F.col("digest"))
    owners = stored(ids.groupBy("digest").agg(F.min("id").alias("rep")).withColumn("ident", ident), "owners")
    wanted = _shared_anchors(rows.select(ident.alias("ident"), "text"), owners, often, buckets)
    release_shuffles(spark)
    spans = _spans(rows.select("id", "digest", "text"), wanted, buckets)
    release_shuffles(spark)
    marks = (
        ids.distinct()
        .join(owners, "digest")
        .join(spans, "ident", "left")
        .select("id", "digest", (F.col("id") > F.col("rep")).alias("copy"), "found")
    )
    return rows.join(marks, ["id", "digest"])


def substring_digests(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [*[pa.int64()] * 4, pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            out = []
            for doc_id, text, found, copy in zip(*(batch[c] for c in ("doc_id", "text", "found", "copy"))):
                raw = text.as_py().encode()
                spans, kept = _kept(raw, found.as_py(), copy.as_py())
                out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield _batch(out, names, types)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = dedup_substrings(docs, often=often).select("row.doc_id", "text", "found", "copy")
    return rows.mapInArrow(digest, schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents with what is kept of their texts, and n_chars, if they have it, counted anew.

    A character of which only some bytes are kept goes whole.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = [
                _kept(text.as_py().encode(), found.as_py(), copy.as_py())[1].decode(errors="ignore")
                for text, found, copy in zip(*(batch[c] for c in ("text", "found", "copy")))
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "kept"])

    rows = dedup_substrings(docs, *others).select("row", "text", "found", "copy")
    kept = rows.mapInArrow(keep, f"row {rows.schema['row'].dataType.simpleString()}, kept string")
    of = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in of:
        of["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[of[c].alias(c) for c in docs.columns])
