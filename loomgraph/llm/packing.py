"""Best-fit packing planned over the histogram of lengths.

Texts are tokenized where they lie; only (length -> count), at most `capacity` rows, reaches the driver. Best-fit
decreasing runs over counts: bins of equal remaining room are one range of sequence numbers, so the plan's size depends on
the number of lengths and not on the number of documents. Pieces then take the planned slots by joining on their
rank within their length.

* Empty table: an empty result. Null or empty text: the one closing id 0, a piece of length 1.
* Null, repeated doc_ids: every row is packed; the rows of one (doc_id, piece) are told apart by their ids' checksum, and equal
  ones are interchangeable.
* Very long texts: cut into pieces of `capacity` ids, the first of which may be shorter.
* Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize, rank_within, ship_package

CAPACITY = 2048
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The ranks of a tokenizer file that is plain byte-level BPE with ids in the order of its merges, else None.

    Such a file and its table of ranks are one model: the pair with the lowest id is merged first."""
    model, before, special = spec["model"], spec.get("pre_tokenizer") or {}, {t["content"] for t in spec.get("added_tokens", ())}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
    if not (plain and level and spec.get("normalizer") is None):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in byte for t in ids for c in t):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [ids.get(t) for t in merged] != list(range(256, 256 + len(merged))) or len(ids) != 256 + len(merged):
        return None
    return {bytes(byte[c] for c in t): i for t, i in ids.items()}


_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian 32-bit bytes, equal to the tokenizer file's own ids.

    The ranks of a plain byte-level file are given to tiktoken, which encodes several times as fast. A text in which a
    special token of the file is spelled out, one that tiktoken's pattern can't hold (millions of spaces in a row), and every
    text under another kind of file go to the tokenizer itself."""
    if path not in _ENCODERS:
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = merge_ranks(json.load(f))

        def slow(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        encode = slow
        if ranks is not None:
            import tiktoken

            quick = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

            def encode(text: str) -> bytes:
                if any(s in text for s in special):
                    return slow(text)
                try:
                    return quick(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
                except ValueError:
                    return slow(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, closing id 0 included."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer_path)
        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        for batch in batches:
            out: dict[str, list] = {name: [] for name in kinds}
            add = [x.append for x in out.values()]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = (encode(text) if text else b"") + b"\0\0\0\0"
                n, at, piece = len(ids) // 4, 0, 0
                end = n % capacity or min(n, capacity)
                while at < n:
                    for to, value in zip(add, (doc_id, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end]))):
                        to(value)
                    at, end, piece = end, end + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first_rank, end_rank, first_bin, per_bin, offset): the pieces of
    that length and of ranks [first_rank, end_rank) fill consecutive bins from first_bin on, per_bin in each, the first at offset."""
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining room -> ranges of bins (first, count)
    rooms: list[int] = []  # sorted
    out, bins = [], 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in ranges:
                bisect.insort(rooms, room)
            ranges[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[i]
            else:  # open as many bins as the rest can need
                room, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            per = room // length
            whole = min(count, left // per)
            if whole:
                out.append((length, rank, rank + whole * per, first, per, capacity - room))
                rank, left = rank + whole * per, left - whole * per
                keep(room - per * length, first, whole)
            first, count = first + whole, count - whole
            if left and count:  # fewer than `per` pieces remain: they share one bin
                out.append((length, rank, rank + left, first, left, capacity - room))
                keep(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            keep(room, first, count)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The plan (some ten thousand rows at most, whatever the input) is broadcast; ranks within a length are salted, so a
    length that a third of all pieces share is numbered by many tasks."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_packing(counts, capacity)
    plan = spark.createDataFrame(rows, "p_length long, first_rank long, end_rank long, first_bin long, per_bin long, base long")
    ranked = rank_within(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "place")
    on = (F.col("length") == F.col("p_length")) & (F.col("place") >= F.col("first_rank")) & (F.col("place") < F.col("end_rank"))
    slot = F.col("place") - F.col("first_rank")
    return ranked.join(F.broadcast(plan), on).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.expr("(place - first_rank) div per_bin")).alias("sequence_id"),
        (F.col("base") + (slot % F.col("per_bin")) * F.col("length")).alias("offset"),
    )
