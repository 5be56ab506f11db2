"""Path expressions: priors, query scores, vendored directories, ordered ignore rules in the syntax of .gitignore files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TESTS = r"/(tests?|testdata|fixtures|__tests__|spec)/|[._](test|spec)[.]|[.]test$"
DOCS = r"/(docs?|man|manual)/|[.](md|markdown|rst|adoc|txt|prebuilt|roff|man|[1-9])$"
BUILT = r"/(single_include|single-include|onefile|amalgamation|generated|dist|build|gen)/|amalgamat"
#: Words of a query that ask for files of a kind, which are then not held back.
ASKS = {
    "workflow": "workflow pipeline ci action".split(), "test": "test tests testing spec specs regression regressions fixture fixtures".split(),
    "doc": "doc docs documentation readme readmes guide guides example examples".split(),
    "built": "generated generator generators codegen codegens build builds dist bundle bundles amalgamation amalgamated single onefile".split(),
}
VENDORED = ("node_modules", "vendor", "third_party", "third-party", "bower_components", "site-packages")
UNLESS_TRACKED = ("build", "dist", "deps")


def prior(path: Column, weights: dict[str, float] | None = None) -> Column:
    """What a path says about a file's worth to a search: sources a little more, tests, documents and built files less unless asked for."""
    weights = weights or {}
    asked = {kind: any(weights.get(w, 0) >= 1 for w in words) for kind, words in ASKS.items()}
    p = F.concat(F.lit("/"), F.lower(F.regexp_replace(path, r"\\", "/")))
    base = F.regexp_extract(p, "[^/]*$", 0)
    flows = F.contains(p, F.lit("/.github/workflows/"))
    score = F.when(p.rlike("/(src|include|lib|packages)/"), 0.5).otherwise(0.0)
    score += F.when(flows, 0.0 if asked["workflow"] else -6.0).when(F.contains(p, F.lit("/.github/")), -12.0).otherwise(0.0)
    score += F.when(p.rlike("/(dependencies|third_party|third-party)/"), -5.0).otherwise(0.0)
    if not asked["test"]:
        score += F.when(p.rlike(TESTS), -12.0).otherwise(0.0)
    if not asked["doc"]:
        score += F.when(p.rlike(DOCS) | base.rlike("^(readme|changelog)"), -6.0).otherwise(0.0)
    if not asked["built"]:
        score += F.when(p.rlike(BUILT) | base.rlike(r"[._]generated[.]|^generated_|[.]min[.]js$"), -6.0).otherwise(0.0)
    return score


def path_score(path: Column, weights: dict[str, float]) -> Column:
    """2.5 w for a term in the base name, else 1.25 w for one in the path; terms that weigh neither 1 nor 1.25 or more don't count."""
    lower = F.lower(path)
    base = F.regexp_extract(lower, "[^/]*$", 0)
    score = F.lit(0.0)
    for term, weight in weights.items():
        if weight == 1 or weight >= 1.25:
            score += F.when(F.contains(base, F.lit(term)), 2.5 * weight).when(F.contains(lower, F.lit(term)), 1.25 * weight).otherwise(0.0)
    return score


def vendored(path: Column, tracked: Column, extra: tuple[str, ...] = ()) -> Column:
    """Below a directory of other people's code; build, dist and deps (and `extra`) count only where the file isn't tracked."""
    whole = F.concat(F.lit("/"), path, F.lit("/"))
    below = lambda names: whole.rlike("/(" + "|".join(map(re.escape, names)) + ")/")
    return below(VENDORED) | (below((*UNLESS_TRACKED, *extra)) & ~tracked)


def _glob(pattern: str) -> str:
    """The regular expression of a glob: ** crosses directories, * and ? don't, [] is a class, a backslash quotes."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.+")
            i += 3
        elif pattern[i] == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append("[^/]*")
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        else:
            if pattern[i] == "\\" and i + 1 < len(pattern):
                i += 1
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


def ignore_rules(lines: list[str]) -> list[tuple[str, str, bool]]:
    """(expression of the path itself, expression of anything below it, ignore) of each rule line; blank lines and comments give none.

    `!` takes back, a slash before the end anchors to the top, one at the end means directories only."""
    out = []
    for line in lines:
        line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        ignore = not line.startswith("!")
        line = line if ignore else line[1:]
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        only_directories, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = ("^" if anchored else "^(?:.*/)?") + _glob(line.lstrip("/"))
        out.append(("(?!)" if only_directories else body + "$", body + "/", ignore))
    return out


def ignored(path: Column, lines: list[str], includes: list[str] | None = None) -> Column:
    """The last rule that matches decides, and one that matches the path itself goes before those that match a directory above it.

    `includes` are applied last: what they match is kept."""
    itself = above = F.lit(None).cast("boolean")
    for own, below, ignore in ignore_rules(lines):
        itself = F.when(path.rlike(own), F.lit(ignore)).otherwise(itself)
        above = F.when(path.rlike(below), F.lit(ignore)).otherwise(above)
    found = F.coalesce(itself, above, F.lit(False))
    for own, below, ignore in ignore_rules(includes or []):
        found = F.when(path.rlike(own) | path.rlike(below), F.lit(not ignore)).otherwise(found)
    return found
