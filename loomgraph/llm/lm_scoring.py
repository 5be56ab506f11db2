"""Language-model scoring by Ziv-Merhav cross-parsing against the whole reference.

A document is cut greedily into the longest phrases that occur in reference text (a word without any occurrence is a
phrase of its own). Few phrases mean text like the reference. With n words, c phrases of the cross-parsing and s phrases
of the document's own LZ78 parsing, the score is (c log2 n - s log2 s) / n, the Ziv-Merhav estimate of the relative entropy per
word; `cross_rate` is c / n. Words are runs of word characters, lower-cased.

The reference is every document of good quality in the labels, all of it, for every document; a document never meets itself
(its doc_id with its text). One suffix automaton of all that fits no task, and automata of parts would each have to read every
document, so the automaton's transitions are looked up where they lie: for k = 2, 3, ... SHORT words, the distinct
k-grams of a batch of documents whose two (k-1)-grams are known to occur go to buckets by hash, which hold the reference's
k-grams and answer with one bit each. A gram is in another document's text if any other posts it, so documents
of the reference ask for two posters. This gives the longest match at each position, up to SHORT words, against all
reference text.

Longer matches are found in the stretches alone that share such grams with another document (`Stretches`). Most stretches occur as a
whole, so that is asked for first, of the places that post their first WHOLE words. In the others, a position that matches m words
asks for m + step, with steps 1, 2, 4, ... until one fails and then by halves of that. Texts of the reference post a place's
longer gram only while someone asks from there, which its bucket tells it. Matches never end before those that begin further left, so
once a position reaches the end of its stretch, so do all to the right and ask no more. The result is the longest match against
all reference text, whatever its length. `SuffixAutomaton` is the same parser for a reference that one task can hold. With `order`, a
phrase of more words is instead one all of whose windows of `order` words occur, which may join two occurrences that overlap:
fewer rounds, but no Ziv-Merhav parsing; the query doesn't use it.

Work is proportional to the text: each of the first rounds moves at most one six-byte entry for a distinct gram of a batch, so a gram
that is repeated a million times costs one entry a batch. The others move 13 bytes for each distinct longer gram still asked for or posted, in
about 2 log2 rounds of the longest match; batches are taken together as less is left. Buckets and batches are bounded by the
parameters at every scale.

* Empty table: an empty result. No reference: every word is a phrase.
* Null or empty text, or no word in it: 0 words, 0 phrases, null scores; very long texts are parsed whole.
* Null doc_id: never reference. Repeated rows get equal scores and don't meet each other; other rows with one doc_id do.
* Further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.buckets import inside, names, packed, runs, six, slices, texts_of, unsix
from loomgraph.llm.words import U64, Fingerprints, distinct, texts_hashes
from loomgraph.session import discard, materialize, ship_package

SHORT = 4
WHOLE, TOLD = 8, 4
BATCH_WORDS = 500_000
BUCKET_GRAMS = 2_000_000


class SuffixAutomaton:
    """All substrings of the texts added. Most states have one successor, kept in two lists; the others have a dict."""

    def __init__(self):
        self.link, self.length, self.symbol, self.target, self.more = [-1], [0], [None], [0], {}
        self.ids: dict[str, int] = {}

    def step(self, state: int, symbol: int) -> int:
        if self.symbol[state] == symbol:
            return self.target[state]
        found = self.more.get(state)
        return -1 if found is None else found.get(symbol, -1)

    def _set(self, state: int, symbol: int, to: int) -> None:
        if self.symbol[state] is None or self.symbol[state] == symbol:
            self.symbol[state], self.target[state] = symbol, to
        else:
            self.more.setdefault(state, {})[symbol] = to

    def _state(self, length: int) -> int:
        self.link.append(-1)
        self.length.append(length)
        self.symbol.append(None)
        self.target.append(0)
        return len(self.link) - 1

    def add(self, words: list[str]) -> None:
        """Start again at the root for each text, so no phrase runs across two texts."""
        ids, link, length, step = self.ids, self.link, self.length, self.step
        last = 0
        for word in words:
            c = ids.setdefault(word, len(ids))
            q = step(last, c)
            if q >= 0:  # the text so far occurs already
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            now, p = self._state(length[last] + 1), last
            while p >= 0 and step(p, c) < 0:
                self._set(p, c, now)
                p = link[p]
            if p < 0:
                link[now] = 0
            else:
                q = step(p, c)
                link[now] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = now

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.symbol[copy], self.target[copy], self.link[copy] = self.symbol[q], self.target[q], self.link[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self.step(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def phrases(self, words: list[str]) -> int:
        """Number of phrases of the greedy longest-match parsing."""
        symbol, target, more, ids = self.symbol, self.target, self.more, self.ids
        state = count = 0
        for c in map(ids.get, words):
            if c is None:
                count += 1 + (state != 0)
                state = 0
                continue
            if symbol[state] == c:
                state = target[state]
                continue
            found = more.get(state)
            to = -1 if found is None else found.get(c, -1)
            if to < 0:  # a phrase ends before this word, which starts the next
                count += 1
                to = target[0] if symbol[0] == c else more[0][c]
            state = to
        return count + (state != 0)


def own_phrases(symbols: list) -> int:
    """Number of phrases of the LZ78 parsing of the text by itself; symbols are small numbers, or are numbered first."""
    if symbols and not isinstance(symbols[0], int):
        ids: dict = {}
        symbols = [ids.setdefault(s, len(ids)) for s in symbols]
    seen: dict[int, int] = {}
    find, node, count = seen.get, 0, 0
    for w in symbols:
        key = node << 32 | w
        node = find(key, 0)
        if not node:
            count += 1
            seen[key] = count
    return count + (node != 0)


def scores(n: int, c: int, s: int) -> tuple[float | None, float | None]:
    """(cross_rate, score) of n words, c phrases of the cross-parsing and s phrases of the text's own."""
    return (c / n, (c * math.log2(n) - s * math.log2(s)) / n) if n else (None, None)


class Batch:
    """Some documents' words in one row; `match[i]` is the longest match found so far at word i."""

    def __init__(self, row, match: bytes | None):
        self.hashes, self.at = texts_hashes(texts_of(row["lengths"], row["text"]))
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.left = self.at[1:][self.doc] - np.arange(len(self.doc))
        self.reference, self.posts = np.array(row["reference"], dtype=bool), np.array(row["posts"], dtype=bool)
        self.prints = Fingerprints(self.hashes)
        self.wanted = np.zeros(len(self.doc), dtype=bool)
        self.match = np.ones(len(self.doc), dtype=np.uint8) if match is None else np.frombuffer(match, dtype=np.uint8).copy()

    def level(self, k: int) -> None:
        """The k-grams that may occur: distinct ones of documents outside and inside the reference, the latter with their posters."""
        known = self.match >= k - 1
        known[:-1] &= known[1:]
        self.where = np.flatnonzero((known | self.posts[self.doc]) & (self.left >= k))  # the reference posts every gram
        grams, doc = self.prints.of(self.where, self.where + k), self.doc[self.where]
        self.inside = self.reference[doc]
        self.outer, self.outer_at = np.unique(grams[~self.inside], return_inverse=True)
        self.inner, self.inner_at = np.unique(grams[self.inside], return_inverse=True)
        posting = self.posts[doc[self.inside]]
        pairs = distinct(self.inner_at[posting].astype(np.int64) << 32 | doc[self.inside][posting])
        self.posters = np.minimum(np.bincount(pairs >> 32, minlength=len(self.inner)), 2).astype(np.uint8)

    def settle(self, k: int, outer: np.ndarray, inner: np.ndarray, wanted: np.ndarray) -> None:
        found = np.empty(len(self.where), dtype=bool)
        found[~self.inside], found[self.inside] = outer[self.outer_at], inner[self.inner_at]
        self.match[self.where[found]] = k
        self.wanted[self.where[self.inside]] = (inner | wanted)[self.inner_at]
        self.wanted &= self.posts[self.doc]


def _among(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked


_REQUEST = "bucket long, batch long, outer binary, inner binary, posters binary, match binary"
_REPLY = "batch long, bucket long, outer binary, inner binary, wanted binary, match binary"


def _asked(number: int, batch: Batch, buckets: int) -> Iterator[tuple]:
    """A row for each bucket that has grams of the batch, and one that carries the matches so far past the buckets."""
    outer, inner = slices(batch.outer, buckets), slices(batch.inner, buckets)
    yield -1 - number, number, None, None, None, batch.match.tobytes()
    for b in np.flatnonzero((np.diff(outer) > 0) | (np.diff(inner) > 0)).tolist():
        a, c = (six(inside(keys[at[b] : at[b + 1]], b, buckets)) for keys, at in ((batch.outer, outer), (batch.inner, inner)))
        yield b, number, a, c, batch.posters[inner[b] : inner[b + 1]].tobytes(), None


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket's replies: whether another document of the reference posts each gram asked for, and whether one outside asks for those posted."""
    if rows["bucket"].iat[0] < 0:
        return rows.assign(wanted=None)[names(_REPLY)]
    inner = [unsix(x) for x in rows["inner"]]
    values, posters = np.concatenate(inner), np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in rows["posters"]])
    values, posters = values[posters > 0], posters[posters > 0]
    order = np.argsort(values)
    values, posters = values[order], posters[order].astype(np.int64)
    first = runs(values)
    once = values[first]
    twice = once[np.add.reduceat(posters, first) > 1] if len(first) else once
    outer = [unsix(x) for x in rows["outer"]]
    asked = distinct(np.concatenate(outer))
    pack = lambda found: np.packbits(found).tobytes()
    return pd.DataFrame({
        "batch": rows["batch"], "bucket": rows["bucket"], "outer": [pack(_among(once, x)) for x in outer],
        "inner": [pack(_among(twice, x)) for x in inner], "wanted": [pack(_among(asked, x)) for x in inner], "match": None,
    })


def _resumed(row, replies: pd.DataFrame, k: int, buckets: int) -> Batch:
    """The batch with its matches of k words settled by the replies."""
    carried = replies["match"].dropna()
    batch = Batch(row, carried.iat[0] if len(carried) else None)
    batch.level(k)
    outer, inner = slices(batch.outer, buckets), slices(batch.inner, buckets)
    found = np.zeros(len(batch.outer), dtype=bool), np.zeros(len(batch.inner), dtype=bool), np.zeros(len(batch.inner), dtype=bool)
    for b, *bits_of in replies.loc[replies["bucket"] >= 0, ["bucket", "outer", "inner", "wanted"]].itertuples(index=False):
        for bits, to, at in zip(bits_of, found, (outer, inner, inner)):
            n = at[b + 1] - at[b]
            to[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n)
    batch.settle(k, *found)
    return batch


def phrase_ends(match: np.ndarray, order: int) -> np.ndarray:
    """Where the greedy phrase that begins at each word ends."""
    i = np.arange(len(match))
    full = match == order
    beyond = np.minimum.accumulate(np.where(full, len(match), i)[::-1])[::-1]
    return np.where(full, beyond - 1 + order, i + match)


class Stretches:
    """The stretches of a batch, or of several, in which matches may be longer than `short` words, with the positions that ask and the places that post.

    A position's match ends between `low` and `high`; it asks whether `length + step` words occur, knowing that `length` do. A place
    posts the same of its text, as often as it has lengths that someone asks from, as far as `reach`. All that ask from one gram have one
    step: the length is short - 1 + step while steps double, and more once they halve."""

    _IN_WORDS, _FREE = ("at", "low", "high", "place", "reach"), ("inner", "length", "step", "posted", "post_step", "x")

    def __init__(self, number: int, batch: Batch, short: int):
        i = np.arange(len(batch.doc))
        ends, reach = phrase_ends(batch.match, short), phrase_ends(np.where(batch.wanted, short, 1), short)
        self.short, self.x = short, batch.hashes
        self.owners, self.sizes, self.docs, self.done = [number], [len(i)], len(batch.at), []
        self.at = self.where = np.flatnonzero((batch.match == short) & (ends > i + short))
        self.low, self.high, self.inner = self.at + short, ends[self.at], batch.reference[batch.doc[self.at]]
        self.length, self.step = np.full(len(self.at), short), np.ones(len(self.at), dtype=np.int64)
        self.place = np.flatnonzero(batch.wanted & (reach > i + short))
        self.reach, self.doc = reach[self.place], batch.doc[self.place]
        self.posted, self.post_step = np.full(len(self.place), short), np.ones(len(self.place), dtype=np.int64)
        self.heads = self.tries = self.lengths = None
        self._shrink()

    @classmethod
    def merged(cls, parts: list[Stretches]) -> Stretches:
        """Several batches' as one: words, positions and documents are numbered on."""
        if len(parts) == 1:
            return parts[0]
        out = cls.__new__(cls)
        shifts = [np.cumsum([0, *n]) for n in ([len(p.x) for p in parts], [sum(p.sizes) for p in parts], [p.docs for p in parts])]
        for names_, shift in ((cls._IN_WORDS, shifts[0]), (("where",), shifts[1]), (("doc",), shifts[2])):
            for name in names_:
                setattr(out, name, np.concatenate([getattr(p, name) + n for p, n in zip(parts, shift)]))
        for name in cls._FREE:
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        for name in ("owners", "sizes", "done"):
            setattr(out, name, [x for p in parts for x in getattr(p, name)])
        out.short, out.docs, out.heads, out.tries = parts[0].short, int(shifts[2][-1]), None, None
        return out

    def weight(self) -> int:
        """What it takes to hold and move, in entries."""
        return max(len(self.at) + len(self.place), len(self.x) // 4, sum(len(b) for _, b in self.done) // 16)

    def _shrink(self) -> None:
        """Set aside the positions whose match is known, and keep only the words that others need."""
        known, still = self.low == self.high, self.low < self.high
        where, length, base = self.where[known], (self.low - self.at)[known], np.cumsum([0, *self.sizes])
        cuts = np.searchsorted(where, base)
        for n in np.flatnonzero(np.diff(cuts)).tolist():
            here = slice(cuts[n], cuts[n + 1])
            self.done.append((self.owners[n], _packed((np.diff(where[here] - base[n], prepend=0), np.diff(length[here], prepend=0)))))
        for name in ("at", "where", "low", "high", "inner", "length", "step"):
            setattr(self, name, getattr(self, name)[still])
        edge = np.zeros(len(self.x) + 1, dtype=np.int64)
        for start, end in ((self.at, self.high), (self.place, self.reach)):
            edge += np.bincount(start, minlength=len(edge)) - np.bincount(end, minlength=len(edge))
        kept = np.cumsum(edge[:-1]) > 0
        to = np.r_[0, np.cumsum(kept)]
        self.x = self.x[kept]
        self.at, self.low, self.high, self.place, self.reach = (to[a] for a in (self.at, self.low, self.high, self.place, self.reach))

    def __getstate__(self) -> dict:
        """Positions as differences, which compress well."""
        return {n: np.diff(a, prepend=0) if isinstance(a, np.ndarray) and a.dtype == np.int64 else a for n, a in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = {n: np.cumsum(a) if isinstance(a, np.ndarray) and a.dtype == np.int64 else a for n, a in state.items()}

    def _entries(self, key: np.ndarray, longer: np.ndarray, inner: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (key, longer) of those that ask and then those that post, sorted, with flags for who asks (1 outside, 2 inside the reference)
        and 4 for each document that posts, up to two. `number` is the entry of each, `cuts` where each bucket begins."""
        order = _order(key, longer)
        key, longer = key[order], longer[order]
        first = _firsts(key, longer)
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(first) - 1
        key, longer = key[first], longer[first]
        self.cuts = slices(key, buckets)
        n, asks, posts = len(key), self.number[: len(inner)], self.number[len(inner) :]
        outside, inside_ = (np.bincount(asks[who], minlength=n) > 0 for who in (~inner, inner))
        posters = np.minimum(np.bincount(distinct(posts << 32 | doc) >> 32, minlength=n), 2)
        return key, longer, (outside + 2 * inside_ + 4 * posters).astype(np.uint8)

    def ask_lengths(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tell the places that post the first WHOLE words of a stretch how long it is: most stretches occur as a whole."""
        self.heads = np.flatnonzero(np.r_[True, self.high[1:] != self.high[:-1]][: len(self.at)] & (self.high - self.at >= WHOLE))
        self.tries = np.flatnonzero(self.reach - self.place >= WHOLE)
        start, prints = np.r_[self.at[self.heads], self.place[self.tries]], Fingerprints(self.x)
        length = np.r_[(self.high - self.at)[self.heads], np.zeros(len(self.tries), dtype=np.int64)]
        return self._entries(prints.of(start, start + WHOLE), length.astype(U64), self.inner[self.heads], self.doc[self.tries], buckets)

    def settle_lengths(self, told: np.ndarray) -> None:
        """Note which lengths were asked of which place, up to TOLD of them."""
        told = told[self.number[len(self.heads) :]].astype(np.int64)
        place, which = np.nonzero((told > 0) & (self.place[self.tries, None] + told <= self.reach[self.tries, None]))
        self.tries, self.lengths = self.tries[place], told[place, which]

    def ask_whole(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the stretches occur as a whole."""
        start, prints = np.r_[self.at[self.heads], self.place[self.tries]], Fingerprints(self.x)
        key = prints.of(start, np.r_[self.high[self.heads], self.place[self.tries] + self.lengths])
        return self._entries(key, np.ones(len(key), dtype=U64), self.inner[self.heads], self.doc[self.tries], buckets)

    def settle_whole(self, told: np.ndarray) -> None:
        mine = told[self.number[: len(self.heads)]]
        found = self.heads[np.where(self.inner[self.heads], mine & 2, mine & 1) > 0]
        self.low[found] = self.high[found]
        self.low = np.maximum.accumulate(self.low)
        self.heads = self.tries = self.lengths = None
        self._shrink()

    def ask(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram and longer gram of each position and place, 0 if there is none."""
        start, length, step = np.r_[self.at, self.place], np.r_[self.length, self.posted], np.r_[self.step, self.post_step]
        prints, end = Fingerprints(self.x), start + length
        fits = end + step <= np.r_[self.high, self.reach]
        longer = np.zeros(len(start), dtype=U64)
        longer[fits] = np.maximum(prints.of(start[fits], (end + step)[fits]) >> U64(16), U64(1))
        return self._entries(prints.of(start, end), longer, self.inner, self.doc, buckets)

    def settle(self, told: np.ndarray) -> None:
        """Go on by what is told of each (gram, longer gram), see _told."""
        told = told[self.number]
        mine, theirs = told[: len(self.at)], told[len(self.at) :]
        found = np.where(self.inner, mine & 2, mine & 1) > 0
        tried, doubling = self.length + self.step, self.length == self.short - 1 + self.step
        self.high = np.where(found, self.high, np.minimum(self.high, self.at + tried - 1))
        self.length = np.where(found, tried, self.length)
        self.step = np.where(found & doubling, 2 * self.step, self.step // 2)
        self.low = np.maximum.accumulate(np.maximum(self.low, self.at + self.length))
        self.high = np.minimum.accumulate(self.high[::-1])[::-1]
        on, stay = np.flatnonzero(theirs & 4), np.flatnonzero(theirs & 8)
        doubling = (self.posted == self.short - 1 + self.post_step)[on]
        step = np.r_[np.where(doubling, 2 * self.post_step[on], self.post_step[on] // 2), self.post_step[stay] // 2]
        posted, both = np.r_[(self.posted + self.post_step)[on], self.posted[stay]], np.r_[on, stay]
        useful = (step > 0) & (self.place[both] + posted < self.reach[both])
        self.posted, self.post_step, both = posted[useful], step[useful], both[useful]
        self.place, self.reach, self.doc = self.place[both], self.reach[both], self.doc[both]
        self._shrink()


def _order(key: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Sorts by key and longer; the latter costs something only where it differs for one key."""
    order = np.argsort(key)
    k, v = key[order], longer[order]
    heads = runs(k)
    differs = np.zeros(len(k), dtype=bool)
    differs[1:] = (k[1:] == k[:-1]) & (v[1:] != v[:-1])
    if differs.any():
        some = np.flatnonzero(np.repeat(np.logical_or.reduceat(differs, heads), np.diff(np.r_[heads, len(k)])))
        order[some] = order[some][np.lexsort((v[some], k[some]))]
    return order


def _firsts(key: np.ndarray, longer: np.ndarray) -> np.ndarray:
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (longer[1:] != longer[:-1])
    return first


def _told(key: np.ndarray, longer: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each entry of a bucket: 1 and 2 if its longer gram occurs to those outside and inside the reference, 4 if someone asks on from there, 8 if someone stays."""
    order = _order(key, longer)
    first = np.flatnonzero(_firsts(key[order], longer[order]))
    if not len(first):
        return np.zeros(0, dtype=np.uint8)
    who = np.bitwise_or.reduceat(flags[order] & 3, first)
    posters = np.where(longer[order][first] > 0, np.add.reduceat((flags[order] >> 2).astype(np.int64), first), 0)
    occurs = (posters > 0) + 2 * (posters > 1)
    heads = runs(key[order][first])
    stays = np.repeat(np.bitwise_or.reduceat(who & ~occurs, heads) > 0, np.diff(np.r_[heads, len(first)]))
    told = np.empty(len(order), dtype=np.uint8)
    told[order] = np.repeat(occurs + 4 * ((who & occurs) > 0) + 8 * stays, np.diff(np.r_[first, len(order)]))
    return told


def _told_lengths(key: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each entry of a bucket, the TOLD longest lengths asked of its gram; stretches of others are asked for like those that don't occur."""
    order = _order(key, length)
    first = np.flatnonzero(_firsts(key[order], length[order]))
    k, v = key[order][first], length[order][first]
    heads = runs(k)
    ends, out = np.r_[heads[1:], len(k)], np.zeros((len(key), TOLD), dtype="<u4")
    group = np.repeat(np.repeat(np.arange(len(heads)), ends - heads), np.diff(np.r_[first, len(order)]))
    for j in range(TOLD):
        at = ends - 1 - j
        out[order, j] = np.where(at >= heads, v[np.maximum(at, 0)], 0)[group]
    return out


_LONGER = "bucket long, batch long, key binary, longer binary, flags binary, state binary, parsed binary, asking long, weight long"
_TOLD = "bucket long, batch long, told binary, state binary, parsed binary, asking long, weight long"


def _packed(value) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def _opened(block: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def _longer(number: int, stretches: Stretches, asked: tuple, parsed: bytes | None) -> pd.DataFrame:
    """A row for each bucket that has entries of the stretches, and one that carries them past the buckets."""
    (key, longer, flags), at, out = asked, stretches.cuts, []
    buckets = len(at) - 1
    for b in np.flatnonzero(np.diff(at) > 0).tolist():
        here = slice(at[b], at[b + 1])
        out.append((b, number, six(inside(key[here], b, buckets)), six(longer[here]), flags[here].tobytes(), None, None, 0, 0))
    out.append((-1 - number, number, None, None, None, _packed(stretches), parsed, len(stretches.at), stretches.weight()))
    return pd.DataFrame(out, columns=names(_LONGER))


def _tell(rows: pd.DataFrame, lengths: bool = False) -> pd.DataFrame:
    """One bucket's replies."""
    if rows["bucket"].iat[0] < 0:
        return rows.assign(told=None)[names(_TOLD)]
    flags = [np.frombuffer(x, dtype=np.uint8) for x in rows["flags"]]
    key, longer = (np.concatenate([unsix(x) for x in rows[c]]) for c in ("key", "longer"))
    told = _told_lengths(key, longer) if lengths else _told(key, longer, np.concatenate(flags))
    ends = np.cumsum([len(x) for x in flags])[:-1]
    return rows.assign(told=[x.tobytes() for x in np.split(told, ends)])[names(_TOLD)]


def _settled(rows: pd.DataFrame) -> tuple[Stretches, np.ndarray]:
    """The stretches of a batch or host, and what is told of their entries."""
    stretches = _opened(rows.loc[rows["bucket"] < 0, "state"].iat[0])
    told = rows[rows["bucket"] >= 0].sort_values("bucket")["told"]
    return stretches, np.frombuffer(b"".join(told), dtype=np.uint8)


def _wholes(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A batch's questions for whole stretches, their lengths being told."""
    stretches, told = _settled(rows)
    stretches.settle_lengths(told.view("<u4").reshape(-1, TOLD))
    parsed = rows.loc[rows["bucket"] < 0, "parsed"].iat[0]
    return _longer(int(rows["batch"].iat[0]), stretches, stretches.ask_whole(buckets), parsed)


def _further(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One host's next questions, after the replies to those of its batches or hosts before."""
    parts = []
    for _, own in rows.groupby("batch", sort=True):
        stretches, told = _settled(own)
        if stretches.heads is None:
            stretches.settle(told)
        else:
            stretches.settle_whole(told)
        parts.append(stretches)
    stretches = Stretches.merged(parts)
    return _longer(int(rows["host"].iat[0]), stretches, stretches.ask(buckets), None)


def _done(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for state in frame["state"]:
            yield pd.DataFrame(_opened(state).done, columns=["batch", "done"])


def _batches(docs: DataFrame, labels: DataFrame, batch_words: int) -> DataFrame:
    """(batch, lengths, text, chars, doc_id, reference, posts): documents in batches of about batch_words words; each text moves once."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))  # rows without doc_id are spread
    rows = rows.join(good, F.col("doc_id").isNotNull() & (F.col("place") == F.col("good_id")), "left")
    again = Window.partitionBy("place", F.xxhash64("text")).orderBy("doc_id")
    reference = F.col("good_id").isNotNull()
    rows = rows.select("doc_id", "text", reference.alias("reference"), (reference & (F.row_number().over(again) == 1)).alias("posts"))

    return packed(rows, 6 * batch_words)


def cross_entropy(docs: DataFrame, labels: DataFrame, order: int | None = None, batch_words: int = BATCH_WORDS, bucket_grams: int = BUCKET_GRAMS, short: int = SHORT) -> DataFrame:
    """One row per document: doc_id, n_words, cross_phrases, own_phrases, cross_rate, score.

    Phrases are the longest that occur; matches of up to `short` words are looked up one length after the other. With `order`, see above."""
    spark = docs.sparkSession
    ship_package(spark)
    held = materialize(_batches(docs, labels, batch_words), "lm-batches")
    chars = held.agg(F.sum("chars")).first()[0] or 0
    buckets = max(1, -(-chars // (6 * bucket_grams)))
    parts, last = held.select("batch", "lengths", "text", "reference", "posts"), order or short

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                batch = Batch(row, None)
                batch.level(2)
                yield pd.DataFrame(_asked(row["batch"], batch, buckets), columns=names(_REQUEST))

    def advance(k: int):
        def run(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            row = rows.iloc[0]
            batch = _resumed(row, replies, k, buckets)
            batch.level(k + 1)
            return pd.DataFrame(_asked(int(row["batch"]), batch, buckets), columns=names(_REQUEST))

        return run

    def own(rows: pd.DataFrame, batch: Batch) -> tuple[list, list, list]:
        """doc_id, where its words begin (and all end) and phrases of its own parsing, for each document."""
        symbols, at = np.unique(batch.hashes, return_inverse=True)[1].tolist(), batch.at.tolist()
        return [None if pd.isna(i) else int(i) for i in rows["doc_id"].iat[0]], at, [own_phrases(symbols[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]

    def scored(parsed: tuple, ends: list) -> pd.DataFrame:
        out = []
        for doc_id, lo, hi, s in zip(parsed[0], parsed[1][:-1], parsed[1][1:], parsed[2]):
            i, c = lo, 0
            while i < hi:
                i, c = ends[i], c + 1
            out.append((doc_id, hi - lo, c, s, *scores(hi - lo, c, s)))
        frame = pd.DataFrame(out, columns=names(_SCORED))
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame[["cross_rate", "score"]] = frame[["cross_rate", "score"]].astype(float)
        return frame

    def finish(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        batch = _resumed(rows.iloc[0], replies, last, buckets)
        return scored(own(rows, batch), phrase_ends(batch.match, last).tolist())

    def stretch(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        batch = _resumed(rows.iloc[0], replies, last, buckets)
        number = int(rows["batch"].iat[0])
        stretches = Stretches(number, batch, last)
        return _longer(number, stretches, stretches.ask_lengths(buckets), _packed((*own(rows, batch), batch.match)))

    def asking(run, asked_of: int):
        return lambda rows: run(rows, asked_of)

    def finish_longer(rows: pd.DataFrame, done: pd.DataFrame) -> pd.DataFrame:
        *parsed, match = _opened(rows["parsed"].iat[0])
        match = match.astype(np.int64)
        for where, length in map(_opened, done["done"]):
            match[np.cumsum(where)] = np.cumsum(length)
        return scored(parsed, (np.arange(len(match)) + match).tolist())

    replies = None
    for k in range(2, last + 1):
        asked = parts.mapInPandas(begin, _REQUEST) if replies is None else parts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(advance(k - 1), _REQUEST)
        now = materialize(asked.groupBy("bucket").applyInPandas(_answer, _REPLY), "lm-replies")
        if replies is not None:
            discard(replies)
        replies = now
    both = held.groupBy("batch").cogroup(replies.groupBy("batch"))
    if order:
        found = both.applyInPandas(finish, _SCORED)
    else:
        told = materialize(both.applyInPandas(stretch, _LONGER).groupBy("bucket").applyInPandas(lambda rows: _tell(rows, True), _TOLD), "lm-longer")
        discard(replies)
        discard(held)
        whole = told.groupBy("batch").applyInPandas(asking(_wholes, buckets), _LONGER).groupBy("bucket").applyInPandas(lambda rows: _tell(rows), _TOLD)
        begun, hosts = materialize(whole, "lm-longer"), None
        discard(told)
        told = begun
        while (left := told.agg(F.sum("asking"), F.sum("weight")).first())[0]:
            # hosts take several batches as what is left becomes less
            spread = F.xxhash64("batch") if hosts is None else F.col("batch")
            hosts = min(hosts or left[1], -(-2 * left[1] // batch_words))
            run = asking(_further, max(1, -(-left[1] // bucket_grams)))
            at_hosts = told.withColumn("host", F.pmod(spread, F.lit(hosts))).groupBy("host").applyInPandas(run, _LONGER)
            now = materialize(at_hosts.groupBy("bucket").applyInPandas(lambda rows: _tell(rows), _TOLD), "lm-longer")
            if told is not begun:
                discard(told)
            told = now
        done = told.filter("bucket < 0").select("state").mapInPandas(_done, "batch long, done binary")
        found = begun.filter("bucket < 0").select("batch", "parsed").groupBy("batch").cogroup(done.groupBy("batch")).applyInPandas(finish_longer, _SCORED)
    blank = F.col("n_words") == 0
    return found.select("doc_id", "n_words", "cross_phrases", "own_phrases", *[F.when(~blank, F.col(c)).alias(c) for c in ("cross_rate", "score")])


_SCORED = "doc_id long, n_words long, cross_phrases long, own_phrases long, cross_rate double, score double"

