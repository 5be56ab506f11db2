"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character; dynamic programming carries the best
score and the piece count of that best path only, without a lattice. Ties follow the tokenizer: among equal scores the
path found first wins, which is the piece that starts earliest; a character without a piece of its own may be taken as unknown
at the least score minus 10; an unknown stretch counts as its UTF-8 bytes where the vocabulary has byte pieces,
else as one token. Spaces become U+2581. Where no piece runs from a word into the next space, stretches of spaces with the word
after them are independent, and their counts are cached; else a text is one stretch.

The vocabulary is read from the file named: a sentencepiece model's pieces and scores. Its control, unknown, unused and byte
pieces are never matched in a text, whatever is spelled there. Scores are summed as doubles.

* Empty table: an empty result. Null or empty text: 0 tokens, score 0. Very long texts and words are processed whole.
* Null or repeated doc_id: each row is counted for itself. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship_package

CACHE_WORDS = 600_000
UNKNOWN_PENALTY = 10.0
MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
INSIDE = re.compile(f"[^{MARK}]{MARK}")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces that texts are made of, with their scores, and whether unknown characters fall back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in plain], sum(map(model.is_byte, ids)) == 256


class UnigramCounter(dict):
    """stretch -> (tokens, score); a cache that starts anew at CACHE_WORDS entries."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes = byte_fallback
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.separable = not any(INSIDE.search(piece) for piece, _ in pieces)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.viterbi(word)
        if len(word) < 64:
            self[word] = found
        return found

    def viterbi(self, word: str) -> tuple[int, float]:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, open_unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(word)
        hit = next(matches, None)
        single, unknown = self.single, self.unknown
        for end in range(1, n + 1):
            top, pieces, is_unknown = None, 0, False
            while hit is not None and hit[0] == end - 1:  # the longest piece, which starts first, comes first
                length, score = hit[1]
                before = best[end - length]
                if before is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[end - length] + 1
                hit = next(matches, None)
            if word[end - 1] not in single and best[end - 1] is not None:
                guess = best[end - 1] + unknown
                if top is None or guess > top:
                    top, is_unknown = guess, True
                    pieces = count[end - 1] + (len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_unknown[end - 1]))
            best[end], count[end], open_unknown[end] = top, pieces, is_unknown
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.separable:
            words = [marked]
        elif MARK + MARK in marked or marked[-1] == MARK:
            words = STRETCH.findall(marked)
        else:
            words = [MARK + w for w in marked[1:].split(MARK)]
        tokens, score = 0, 0.0
        for word in words:
            n, s = self[word]
            tokens += n
            score += s
        return tokens, score


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = UnigramCounter(*vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens, score. A narrow map: no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model_path).count
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            found = [count(t) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_chars": [len(t) for t in texts], "n_tokens": [f[0] for f in found], "score": [f[1] for f in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_chars long, n_tokens long, score double")
