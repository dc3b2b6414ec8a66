"""Texts bundled where they lie, so that a bundle names each of its tokens once.

A bundle's distinct tokens are dealt into parts by a hash. Each part of a bundle is one row of compressed
arrays, so all that is shuffled to number the tokens, and to count the texts with them, is a row for each
bundle and part instead of one for each token of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part of a bundle's tokens: the bytes of each, all bytes, and how many of the bundle's texts have it.
PART = "struct<sizes: binary, bytes: binary, texts: binary>"
NAMED = "block long, part int, ids binary, df binary"


def shrunk(values) -> bytes:
    """The bytes of an array, compressed, after their number."""
    import pyarrow as pa

    return len(values.tobytes()).to_bytes(8, "little") + pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def grown(stored: bytes, kind: str):
    """The array that ``shrunk`` stored."""
    import numpy as np
    import pyarrow as pa

    size = int.from_bytes(stored[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(stored[8:], size, asbytes=True), kind) if size else np.zeros(0, kind)


def in_parts(tokens, texts, parts: int):
    """(place of each token, an array of the ``PART`` of each part): distinct ``tokens`` by part, in order within each."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    values = tokens.to_numpy(zero_copy_only=False).astype(object)
    part = (pd.util.hash_array(values, categorize=False) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((np.argsort(np.argsort(values)), part)) if len(values) else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    held = tokens.take(pa.array(order)).cast(pa.large_string())
    ends = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1] if len(held) else np.zeros(1, np.int64)
    raw = np.frombuffer(held.buffers()[2] or b"", np.uint8) if len(held) else np.zeros(0, np.uint8)
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    kind = pa.struct([(name, pa.binary()) for name in ("sizes", "bytes", "texts")])
    made = [
        {"sizes": shrunk(np.diff(ends[a : b + 1]).astype(np.int32)), "bytes": shrunk(raw[ends[a] : ends[b]]),
         "texts": shrunk(texts[order[a:b]].astype(np.int32))}
        for a, b in zip(edges[:-1], edges[1:])
    ]
    return place, pa.array([made], pa.list_(kind))


def tokens_of(sizes: bytes, held: bytes):
    """The tokens of a part."""
    import numpy as np
    import pyarrow as pa

    ends = np.r_[0, np.cumsum(grown(sizes, "int32"), dtype=np.int64)]
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(grown(held, "uint8").tobytes()))


def named_tokens(bundles: DataFrame, parts: int) -> DataFrame:
    """``NAMED``: for each part of a bundle (block, parts) the numbers of its tokens and how many texts have each.

    Numbers tell the tokens of a part apart; those of one text have -1.
    """
    rows = bundles.select("block", F.posexplode("parts").alias("part", "held")).select("block", "part", "held.*")
    return rows.repartitionById(parts, "part").mapInArrow(_naming, NAMED)


def _naming(batches):
    import numpy as np
    import pyarrow as pa

    held = {}
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "sizes", "bytes", "texts"))):
            held.setdefault(part, []).append(row)
    for part, rows in held.items():
        rows.sort()
        tokens = [tokens_of(sizes, held) for _, sizes, held, _ in rows]
        codes = pa.concat_arrays(tokens).dictionary_encode().indices.to_numpy()
        df = np.bincount(codes, np.concatenate([grown(texts, "int32") for *_, texts in rows])).astype(np.int32)
        ends = np.cumsum([0, *map(len, tokens)])
        own = [codes[a:b] for a, b in zip(ends[:-1], ends[1:])]
        ids = [shrunk(np.where(df[c] > 1, c, -1).astype(np.int32)) for c in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()),
             pa.array(ids, pa.binary()), pa.array([shrunk(df[c]) for c in own], pa.binary())],
            names=["block", "part", "ids", "df"],
        )


def cut(batches, room: int):
    """Tables of whole rows of the batches (.., tokens), about ``room`` tokens each."""
    import numpy as np
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("tokens").value_lengths().fill_null(0)))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = int(np.searchsorted(ends, before + room - size, "right"))
            if end == start and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                continue
            end = max(end, start + 1)
            held.append(batch.slice(start, end - start))
            size, start = size + int(ends[end - 1]) - before, end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
