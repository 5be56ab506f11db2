"""A search question as weighted terms: code-like words, acronyms, fragments, plain words and word forms."""

from __future__ import annotations

import re

TERMS = 48
STOP = frozenset("a an and are as at be but by can do does for from has have how in into is it its not of on or so that the their then this to use uses using was what when where which who why will with you your".split())
_WORD = re.compile(r"[\w./:$+#-]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_A-Za-z]+")


def code_like(raw: str) -> bool:
    """Spelled as code is: with joining signs, a leading --, or capitals after the first letter."""
    bare = raw.strip("./:-")
    if re.search(r"[_./:$+#]", bare) or raw.startswith("--"):
        return True
    return any(c.isupper() for c in bare[1:])


def code_weight(raw: str) -> float:
    letters = [c for c in raw.strip("./:+-") if c.isalpha()]
    return 1.4 if 0 < len(letters) <= 4 and not any(c.islower() for c in letters) else 2.5


def variants(raw: str) -> list[str]:
    """The word in lower case, its parts between signs, and their parts between changes of case."""
    raw = raw.strip("./:-")
    parts = [p for p in re.split(r"[\W_]+", raw) if p]
    out = [raw, *parts]
    for p in parts:
        out += re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^A-Z]+|[A-Z]+", p)
    return list(dict.fromkeys(v.lower() for v in out if v))


def word_forms(term: str) -> list[str]:
    """Simpler forms of an English word."""
    out = []
    for tail, put in (("ization", ["ize"]), ("ification", ["ify"]), ("ing", ["", "e"]), ("ed", ["", "e"])):
        if term.endswith(tail) and len(term) > len(tail) + 2:
            out += [term[: -len(tail)] + p for p in put]
            break
    if term.endswith("s") and not term.endswith("ss") and len(term) > 4:
        out.append(term[:-1])
    return list(dict.fromkeys(out))


def parse(question: str, most: int = TERMS) -> dict[str, float]:
    """term -> weight: 2.5 code-like (1.4 for short acronyms), 1.1 their fragments, 1 plain words, .55 word forms; the highest weight of a term
    counts, and at most `most` terms are kept in order of appearance."""
    out: dict[str, float] = {}

    def put(term: str, weight: float) -> None:
        if len(term) > 1 and (term in out or len(out) < most):
            out[term] = max(weight, out.get(term, 0.0))

    words = _WORD.findall(question)
    for raw in words:
        found = variants(raw)
        if not found:
            continue
        if code_like(raw):
            put(found[0], code_weight(raw))
            for part in found[1:]:
                if part not in STOP:
                    put(part, 1.1)
        elif found[0] not in STOP:
            for part in found:
                put(part, 1.0)
    for raw in words:
        plain = raw.strip("./:-").lower()
        if not code_like(raw) and plain not in STOP:
            for form in word_forms(plain):
                put(form, 0.55)
    return out
