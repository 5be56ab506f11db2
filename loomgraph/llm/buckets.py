"""Packed exchange between batches of texts and buckets of 64-bit keys: sorted keys go out six bytes each, answers come back in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.llm.words import U64

BATCH_ROWS = 65536
_EDGES: dict[int, np.ndarray] = {}


def edges(buckets: int) -> np.ndarray:
    """The least key of each bucket; buckets are equal ranges of keys."""
    if buckets not in _EDGES:
        _EDGES.clear()
        _EDGES[buckets] = np.array([-(-(b << 64) // buckets) for b in range(buckets)], dtype=U64)
    return _EDGES[buckets]


def slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins, and their number."""
    return np.r_[np.searchsorted(keys, edges(buckets)), len(keys)]


def inside(keys: np.ndarray, bucket, buckets: int) -> np.ndarray:
    """The keys' 48 highest bits within their bucket, in the same order."""
    return (keys - edges(buckets)[bucket]) >> U64(max(0, 16 - (buckets.bit_length() - 1)))


def six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64, copy=False)


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def packed(rows: DataFrame, batch_chars: int) -> DataFrame:
    """rows(text, ...) as (batch, lengths, text, chars and an array of each further column), about batch_chars of text or BATCH_ROWS rows each.

    Texts are one zstandard block, which texts_of() opens, so that batches are cheap to move. Nothing is shuffled here."""
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        number, held, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def out() -> pd.DataFrame:
            lengths = np.fromiter((len(t) if isinstance(t, str) else -1 for t in texts), dtype="<i4", count=len(texts))
            whole = squeeze("".join(t for t in texts if isinstance(t, str)).encode("utf-8", "surrogatepass"))
            columns = zip(*held) if kinds else []
            return pd.DataFrame({"batch": [number], "lengths": [lengths.tobytes()], "text": [whole], "chars": [chars], **{name: [list(values)] for (name, _), values in zip(kinds, columns)}})

        for frame in frames:
            columns = [[None if pd.isna(i) else int(i) for i in frame[n].astype("Int64")] if kind == "bigint" else frame[n].tolist() for n, kind in kinds]
            for i, text in enumerate(frame["text"].tolist()):
                held.append([c[i] for c in columns])
                texts.append(text)
                chars += len(text) if isinstance(text, str) else 0
                if chars >= batch_chars or len(texts) == BATCH_ROWS:
                    yield out()
                    number, held, texts, chars = number + 1, [], [], 0
        if texts:
            yield out()

    return rows.mapInPandas(run, ", ".join(["batch long", "lengths binary", "text binary", "chars long", *(f"`{n}` array<{kind}>" for n, kind in kinds)]))


def texts_of(lengths: bytes, text: bytes) -> list[str | None]:
    """The texts of a batch."""
    import zstandard

    whole, at, out = zstandard.ZstdDecompressor().decompress(text).decode("utf-8", "surrogatepass"), 0, []
    for n in np.frombuffer(lengths, dtype="<i4").tolist():
        out.append(whole[at : at + n] if n >= 0 else None)
        at += max(n, 0)
    return out
