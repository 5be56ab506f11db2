"""Language identification by compression: encode a text with one zstandard raw-content dictionary per language and take
the language whose encoding is smallest; narrow margins are rejected.

Texts are lower-cased and every run of non-letters becomes one space, in dictionaries and texts alike, so case, digits and
decoration don't hide a language. A text is encoded whole, in blocks of BLOCK bytes, because a dictionary helps
most near the start of a frame; the blocks' sizes are summed.

Dictionaries are fitted on a bounded sample: per language the `sample_rows` labelled rows with the smallest hashes,
one slice of at most `slice_chars` characters each, `dictionary_bytes` bytes in all. Everything else covers all rows.

* Empty table, or no labelled row: an empty result, or every row `und`.
* Null text, or one without any letter: `und`, score 0, not accepted. Equal sizes: the language first by code point, score 0.
* Null doc_id: never learned from and not held out. Repeated rows get equal answers. Further columns are carried by `keep_accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import free_name, ship_package

SAMPLE_ROWS = 96
SLICE_CHARS = 1000
DICTIONARY_BYTES = 32_000
LEVEL = 6
BLOCK = 2048
MIN_MARGIN = 0.002
SCORE_HALF = 0.02
_CLEAN = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's words, lower-cased; empty unless one holds a letter (numerals such as 2/3 or VII as one character don't count)."""
    clean = _CLEAN.sub(" ", text.lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slice_chars: int = SLICE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """language -> raw dictionary, from rows that are labelled and not held out. The driver gets sample_rows rows a language.

    The first pass finds the smallest hashes per language without reading text (a window limit applied per task before
    the shuffle); the second reads the texts of those rows alone."""
    docs = docs.select("doc_id", "lang", "text")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("pick_", F.xxhash64(F.col("doc_id"), F.lit(11)))
    first = Window.partitionBy("lang").orderBy("pick_")
    picked = usable.select("lang", "pick_").withColumn("nth_", F.row_number().over(first)).filter(F.col("nth_") <= sample_rows).groupBy("lang").agg(F.max("pick_").alias("last_"))
    picked = picked.select(F.col("lang").alias("lang_"), "last_")
    start = F.pmod(F.col("pick_"), F.greatest(F.length("text") - slice_chars + 1, F.lit(1))) + 1
    rows = (
        usable.join(F.broadcast(picked), (F.col("lang") == F.col("lang_")) & (F.col("pick_") <= F.col("last_")))
        .filter(F.col("text").isNotNull())
        .select("lang", "pick_", F.substring(F.col("text"), start.cast("int"), F.lit(slice_chars)).alias("slice"))
        .distinct()
    )
    slices: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        slices.setdefault(r["lang"], []).append((r["pick_"], r["slice"]))
    out = {}
    for lang, found in sorted(slices.items()):
        seen = dict.fromkeys(letters(s) for _, s in sorted(found))
        whole = " ".join(seen).encode()[:dictionary_bytes]
        if whole:
            out[lang] = whole
    return out


_CODERS: dict[int, list] = {}


def _coders(dictionaries: dict[str, bytes], level: int) -> list:
    import zstandard

    key = hash((level, tuple(sorted(dictionaries.items()))))
    if key not in _CODERS:
        _CODERS.clear()
        made = []
        for lang in sorted(dictionaries):
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _CODERS[key] = made
    return _CODERS[key]


def classify(text: str | None, coders: list) -> tuple[str, float, float]:
    """(language, score, margin); the margin is the share by which the runner-up's encoding is larger."""
    clean = letters(text) if isinstance(text, str) else ""
    if not clean or not coders:
        return "und", 0.0, 0.0
    data = clean.encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in coders)
    runner = sizes[1][0] if len(sizes) > 1 else len(data) + 9 * len(blocks)
    margin = max(0.0, (runner - sizes[0][0]) / runner)
    return sizes[0][1], 1.0 - 0.5 ** (margin / SCORE_HALF), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, level: int = LEVEL, carry: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `carry`), lang_pred, score, margin, accepted; a narrow map over text alone."""
    ship_package(docs.sparkSession)
    carry = carry or ["doc_id"]
    text, pred, score, margin, accepted = (free_name(docs, n) if n != "text" else n for n in ("text", "lang_pred", "score", "margin", "accepted"))
    columns = carry if text in carry else [*carry, text]
    source = docs.select(*columns)
    schema = source.select(*carry).schema.add(pred, "string").add(score, "double").add(margin, "double").add(accepted, "boolean")

    def run(batches) -> Iterator:
        import pyarrow as pa

        coders = _coders(dictionaries, level)
        for batch in batches:
            found = [classify(t, coders) for t in batch.column(text).to_pylist()]
            out = [batch.column(c) for c in carry]
            out += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            out.append(pa.array([f[0] != "und" and f[2] >= min_margin for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=[*carry, pred, score, margin, accepted])

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin, accepted."""
    found = predict(docs, fit(docs), min_margin)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def keep_accepted(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without those whose language is rejected, all columns kept."""
    found = predict(docs, fit(docs), min_margin, carry=docs.columns)
    return found.filter(F.col(found.columns[-1])).select(*[F.col(c) for c in docs.columns])
