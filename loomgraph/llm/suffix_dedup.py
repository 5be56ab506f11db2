"""Repeated passages by a sparse suffix array.

A passage is `length` consecutive words (runs of word characters, lower-cased). Of every such window the suffix at
its minimiser (the k-gram with the smallest hash, the leftmost of equals) is retained: equal windows retain the
suffix at the same place, and one suffix serves a run of windows, so about one word in twenty is kept.

Equal windows thus meet at equal anchors (the retained suffix's first k words). Instead of sorting suffixes by words and extending
matches of neighbours to the left and right, which finds for each suffix only its best neighbour on one side, they are grouped by
the anchor's fingerprint and by that of the context, the stretch left and right of the anchor that the suffix's windows cover:
suffixes of one context match over all of it, and of each distinct context of an anchor one representative's windows are
compared by fingerprint with those of the others, on both sides at once. So the result is exact (up to 64+64-bit
fingerprints): every window of `length` words that occurs more than once, and only those.

Of equal windows the first (by row, then place) stays; the others are what deduplication drops.

* Empty table, null or empty text, texts shorter than `length` words: no rows.
* Null or repeated doc_id: every row counts as a document of its own; a row that is there twice repeats itself, and of its copies
  one keeps its text in `without_repeats`.
* Very long texts are processed whole. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.words import U64, WORD, Fingerprints, scramble, texts_hashes, word_hashes
from loomgraph.session import HEAVY_SHARE, join_hot, materialize, ship_package

LENGTH = 50
GRAM = 12


def retained(x: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, context, first window, windows) of each retained suffix of a sequence of word hashes."""
    windows = len(x) - length + 1
    if windows <= 0:
        return (np.zeros(0, dtype=U64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    prints = Fingerprints(x)
    start = np.arange(len(x) - gram + 1)
    grams = prints.of(start, start + gram)
    span = length - gram + 1
    at = np.empty(windows, dtype=np.int64)
    for i in range(0, windows, 65536):  # blocks keep memory flat on very long texts
        part = grams[i : min(i + 65536, windows) + span - 1]
        at[i : i + len(part) - span + 1] = np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1)
    at += np.arange(windows)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, windows])
    place = at[first]
    context = scramble(prints.of(first, first + count - 1 + length) + (place - first).astype(U64))
    return grams[place], context, first, count


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, owner, words = [], [], []
            for i in range(0, len(batch), 256):  # some hundred texts at a time keep memory flat
                x, at = texts_hashes(batch["text"].iloc[i : i + 256].tolist())
                for j, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    parts.append(retained(x[lo:hi], length, gram))
                    owner += [i + j] * len(parts[-1][2])
                    words += [hi - lo] * len(parts[-1][2])
            if not owner:
                continue
            anchor, context, first, count = (np.concatenate(p) for p in zip(*parts))
            yield pd.DataFrame({
                "row_no": batch["row_no"].to_numpy()[owner], "doc_id": batch["doc_id"].astype("Int64").array[owner], "text_key": batch["text_key"].to_numpy()[owner],
                "words": words, "anchor": anchor.view(np.int64), "context": context.view(np.int64), "first": first, "n": count,
            })

    keyed = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInPandas(run, "row_no long, doc_id long, text_key long, words int, anchor long, context long, first int, n int")


def window_rows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The windows of the wanted contexts: (anchor, print, context, at, row_no, place, copies)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row_no, text, items in zip(batch["row_no"], batch["text"], batch["items"]):
                prints = Fingerprints(word_hashes(text))
                first = np.array([i["first"] for i in items], dtype=np.int64)
                n = np.array([i["n"] for i in items], dtype=np.int64)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(first, n) + at
                spread = lambda name, items=items, n=n: np.repeat(np.array([i[name] for i in items], dtype=np.int64), n)
                out.append(pd.DataFrame({"anchor": spread("anchor"), "print": prints.of(place, place + length).view(np.int64), "context": spread("context"), "at": at, "row_no": row_no, "place": place, "copies": spread("copies")}))
            if out:
                yield pd.concat(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    asked = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "row_no", "items")
    joined = texts.join(asked, texts["doc_id"].eqNullSafe(asked["w_id"]) & (F.col("text_key") == F.col("w_key")))
    return joined.select("row_no", "text", "items").mapInPandas(run, "anchor long, print long, context long, at int, row_no long, place int, copies long")


_SPOT = ("row_no", "place")


def _resolve(windows: DataFrame, lo, hi, most) -> DataFrame:
    """Bit masks per context of the windows that repeat, and of those whose first occurrence is here."""
    bit = F.expr("shiftleft(1L, at)")
    return windows.filter((lo != hi) | (most > 1)).groupBy("anchor", "context").agg(
        F.bit_or(bit).alias("dup"), F.bit_or(F.when(F.struct(*_SPOT) == lo, bit).otherwise(F.lit(0).cast("long"))).alias("own")
    )


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per retained suffix with repeats: row_no, doc_id, words, first, n, dup, drop (bits of its n windows)."""
    if length - gram + 1 > 63 or gram < 1 or length < gram:
        raise ValueError("a suffix serves at most length - gram + 1 windows, which must be 1 to 63")
    kept = materialize(suffixes(docs, length, gram), "suffixes")
    rows = kept.count()
    contexts = kept.groupBy("anchor", "context").agg(
        F.min(F.struct("row_no", "first", "doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")
    )
    contexts = materialize(contexts, "contexts")
    anchors = contexts.groupBy("anchor").agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("variants")).filter("all_copies > 1")
    shared = materialize(join_hot(contexts, materialize(anchors, "anchors"), ["anchor"], "variants", rows), "shared")
    whole = shared.filter("variants = 1").select("anchor", "context", F.expr("shiftleft(1L, n) - 1").alias("dup"), F.expr("shiftleft(1L, n) - 1").alias("own"))
    several = shared.filter("variants > 1")
    item = F.struct("anchor", "context", F.col("rep.first").alias("first"), "n", "copies")
    wanted = several.groupBy(F.col("rep.row_no").alias("row_no"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")).agg(F.collect_list(item).alias("items"))
    windows = materialize(window_rows(docs, wanted, length), "windows")
    # an anchor with more than 1/1000 of the contexts is hot (at most 1000 of these): its windows are aggregated and joined,
    # all others are settled in one shuffle by anchor
    hot = F.broadcast(several.filter(F.col("variants") * HEAVY_SHARE > rows).select("anchor").distinct())
    calm = windows.join(hot, "anchor", "left_anti").repartition("anchor")
    same = Window.partitionBy("anchor", "print")
    spot = F.struct(*_SPOT)
    calm = calm.withColumns({"lo": F.min(spot).over(same), "hi": F.max(spot).over(same), "most": F.max("copies").over(same)})
    in_calm = _resolve(calm, F.col("lo"), F.col("hi"), F.col("most"))
    busy = windows.join(hot, "anchor", "left_semi")
    ends = busy.groupBy("anchor", "print").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.max("copies").alias("most"), F.count(F.lit(1)).alias("weight"))
    in_busy = _resolve(join_hot(busy, ends, ["anchor", "print"], "weight", rows), F.col("lo"), F.col("hi"), F.col("most"))
    masks = whole.unionByName(in_calm).unionByName(in_busy)
    marked = materialize(shared.select("anchor", "context", F.col("rep.row_no").alias("rep_row"), F.col("rep.first").alias("rep_first"), "copies").join(masks, ["anchor", "context"]), "masks")
    found = join_hot(kept, marked, ["anchor", "context"], "copies", rows)
    first_here = (F.col("row_no") == F.col("rep_row")) & (F.col("first") == F.col("rep_first"))
    drop = F.col("dup").bitwiseAND(F.when(first_here, F.bitwise_not("own")).otherwise(F.lit(-1).cast("long")))
    return found.select("row_no", "doc_id", "text_key", "words", "first", "n", "dup", drop.alias("drop"))


def _spans(items, name: str, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for item in items:
        bits, at = int(item[name]), item["first"]
        while bits:
            skip = (bits & -bits).bit_length() - 1
            at, bits = at + skip, bits >> skip
            run = (~bits & (bits + 1)).bit_length() - 1
            if out and at <= out[-1][1]:
                out[-1][1] = max(out[-1][1], at + run - 1 + length)
            else:
                out.append([at, at + run - 1 + length])
            at, bits = at + run, bits >> run
    return [(a, b) for a, b in out]


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document that has repeats: doc_id, n_words, repeat_words, drop_words, repeats, drops, text_key.

    repeats and drops are maximal word ranges "start:end,..." (end exclusive): all repeated passages, and those of them that
    repeat an earlier occurrence. Documents without repeats have no row."""
    found = repeated_windows(docs, length, gram)
    item = F.struct("first", "n", "dup", "drop")
    per = found.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("words").alias("n_words"), F.sort_array(F.collect_list(item)).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spell = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        for batch in batches:
            repeats = [_spans(items, "dup", length) for items in batch["items"]]
            drops = [_spans(items, "drop", length) for items in batch["items"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_words": batch["n_words"], "repeat_words": [sum(b - a for a, b in s) for s in repeats],
                "drop_words": [sum(b - a for a, b in s) for s in drops], "repeats": list(map(spell, repeats)), "drops": list(map(spell, drops)), "text_key": batch["text_key"],
            })

    return per.select("doc_id", "text_key", "n_words", "items").mapInPandas(run, "doc_id long, n_words long, repeat_words long, drop_words long, repeats string, drops string, text_key long")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text) of all documents with the words of later occurrences cut out of their texts.

    Rows equal in doc_id and text are interchangeable: the n-th of them takes the n-th of their drops."""
    ship_package(docs.sparkSession)
    nth = lambda *order: F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(*order))
    found = repeated_passages(docs, length, gram).withColumn("nth", nth("drops"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").withColumn("nth", nth("text_key")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")) & (F.col("d.nth") == F.col("f.nth"))
    joined = keyed.join(found.alias("f"), on, "left").select("d.doc_id", "d.text", "f.drops")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [cut(t, d) for t, d in zip(batch["text"], batch["drops"])]})

    return joined.mapInPandas(run, "doc_id long, text string")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where in text the words of its lower-cased form are; lower-casing may lengthen a text or split a word."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in found]


def cut(text: str | None, drops: str | None) -> str | None:
    """text without the word ranges of `drops`."""
    if not isinstance(text, str) or not isinstance(drops, str) or not drops:
        return text if isinstance(text, str) else None
    at, out, last = word_spans(text), [], 0
    for part in drops.split(","):
        a, b = map(int, part.split(":"))
        out.append(text[last : max(last, at[a][0])])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])
