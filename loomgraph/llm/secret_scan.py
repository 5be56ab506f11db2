"""Secret scans with multipart credential linking.

Strong parts are found alone: an assignment to a password-like name, an access identifier, a long hex run. Weak parts
(a long mixed token, an endpoint, a user or client identifier) say nothing alone; they are reported only where
complementary parts co-occur: parts are intervals, and an interval join within a scope (a paragraph, and at most `reach`
code points apart) links each weak token to the nearest identifier and each endpoint or identifier to the nearest secret.
The join runs as a bisection over sorted intervals in one pass per document, so no pairs are listed.

* Empty table: an empty result. Null or empty text: no spans. Very long texts are scanned whole.
* Null or repeated doc_id: each row is scanned for itself. Further columns are ignored by `scan`.
* Overlap: a weak part that overlaps a strong one is dropped; equal starts are ordered as in KINDS, then by end.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.session import ship_package

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "endpoint", "identifier")
REACH = 200


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so this equals "+" with short matches dropped
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
URL = re.compile(r"(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|amqp|redis)://[A-Za-z0-9._:@-]+")
HOST = re.compile(r"(?<![a-z0-9.-])[a-z0-9.-]+(?=:([0-9]{2,5})\b)")  # only at the start of a run, so a long one is read once
IDENTIFIER = re.compile(r"\b(?:user(?:_?name|_?id)?|login|client_?id|account_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.ASCII)
BREAK = re.compile(r"\n\s*\n")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong parts, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap joined, as an assignment and the hex run in it do."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _near(spans: list[tuple[int, int]], start: int, end: int, reach: int) -> bool:
    """Whether one of the sorted, disjoint spans lies within `reach` of [start, end)."""
    i = bisect.bisect_left(spans, (start, 0))
    return (i < len(spans) and spans[i][0] - end <= reach) or (i > 0 and start - spans[i - 1][1] <= reach)


def endpoints_of(text: str) -> list[tuple[int, int]]:
    """URLs, and hosts of two labels or more with a port, in order and without overlap."""
    found = [(m.start(), m.end()) for m in URL.finditer(text)]
    starts = [s for s, _ in found]
    for m in HOST.finditer(text):
        name = m[0].rpartition("..")[2].lstrip(".-")
        i = bisect.bisect_right(starts, m.end()) - 1
        if "." in name and not name.endswith(".") and (i < 0 or found[i][1] <= m.end() - len(name)):
            found.append((m.end() - len(name), m.end(1)))
    return sorted(found)


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """Weak parts that complementary parts of their scope confirm. Without a part that anchors a credential there is nothing to link."""
    endpoints = endpoints_of(text) if ":" in text else []
    ids = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    if not (base or endpoints or ids):
        return []
    strong = sorted((s, e) for s, _, e in base)
    highest: list[int] = []
    for _, e in strong:
        highest.append(max(e, highest[-1]) if highest else e)

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(strong, (e, 0))
        return not i or highest[i - 1] <= s

    def mixed(s: int, e: int) -> bool:
        i = bisect.bisect_left(endpoints, (s, 0))
        return bool(DIGIT.search(text, s, e) and LETTER.search(text, s, e)) and not any(a < e and s < b for a, b in endpoints[max(0, i - 1) : i + 1])

    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text) if free(m.start(), m.end()) and mixed(m.start(), m.end())]
    endpoints, ids = [x for x in endpoints if free(*x)], [x for x in ids if free(*x)]
    breaks = [m.start() for m in BREAK.finditer(text)]
    scope = lambda at: bisect.bisect_right(breaks, at)
    parts: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for name, spans in (("access", [(s, e) for s, k, e in base if k == 1]), ("secret", _merged([(s, e) for s, k, e in base if k != 1])), ("token", tokens), ("endpoint", endpoints), ("identifier", ids)):
        for s, e in sorted(spans):
            parts.setdefault(scope(s), {}).setdefault(name, []).append((s, e))
    out = []
    for own in parts.values():
        near = lambda name, s, e, own=own: _near(own.get(name, []), s, e, reach)
        sure = [t for t in own.get("token", []) if near("access", *t) or (near("identifier", *t) and near("endpoint", *t))]
        own["sure"] = sure
        out += [(s, 3, e) for s, e in sure]
        out += [(s, 4, e) for s, e in own.get("endpoint", []) if (near("secret", s, e) or near("sure", s, e)) and (near("access", s, e) or near("identifier", s, e))]
        out += [(s, 5, e) for s, e in own.get("identifier", []) if near("secret", s, e) or near("sure", s, e)]
    return out


def _spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None, reach: int = REACH) -> tuple[int, int, int, str, str]:
    base = base_spans(text or "")
    spans = sorted(base + linked_spans(text or "", base, reach))
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, hashlib.sha256(_spell(base).encode()).hexdigest(), _spell(spans))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. A narrow map: no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scan_text(t if isinstance(t, str) else None, reach) for t in batch["text"].array], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
