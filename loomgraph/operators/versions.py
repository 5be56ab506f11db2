"""Two versions of a tree: entities paired in passes of falling evidence, changes, renames within a file, moves across files, text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, ship_package, unbroadcast

#: (columns that must agree besides kind and name, columns that must not be empty, only where both sides have one).
PASSES = [
    (("signature", "body", "fingerprint"), ("body", "fingerprint"), False),
    (("signature", "body"), ("body",), False),
    (("signature", "fingerprint"), ("fingerprint",), False),
    (("signature",), (), False),
    (("body", "fingerprint"), ("body", "fingerprint"), True),
    (("fingerprint",), ("fingerprint",), True),
    (("body",), ("body",), True),
    ((), (), False),
]
THRESHOLD, MARGIN = 0.92, 0.05
CONTENT = ["name", "signature", "body", "fingerprint", "pos"]


def paired(before: DataFrame, after: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Entities(scope..., kind, name, signature, body, fingerprint, pos) of both versions, with the pass that paired them.

    One row a pair or lone entity: scope, kind, name, pass (null where lone), and old_ and new_ signature, body, fingerprint, pos.
    Entities of a name are numbered by pos among those of equal evidence; the n-th of one side meets the n-th of the other. All passes
    are windows over (scope, kind, name), so rows are shuffled once for them."""
    group = [*scope, "kind", "name"]
    columns = [*group, "signature", "body", "fingerprint", "pos"]
    rows = before.select(*columns, F.lit(0).alias("side")).unionByName(after.select(*columns, F.lit(1).alias("side")))
    rows = rows.withColumns({"pass": F.lit(None).cast("int"), "slot": F.lit(None).cast("string")}).repartition(*[F.col(c) for c in group])
    for number, (evidence, filled, unique) in enumerate(PASSES, 1):
        ready = F.col("pass").isNull()
        for c in filled:
            ready = ready & (F.coalesce(F.col(c), F.lit("")) != "")
        rows = rows.withColumn("ready", ready)
        alike = Window.partitionBy(*group, "ready", *evidence)
        sides = [F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(alike) for s in (0, 1)]
        rows = rows.withColumns({"nth": F.row_number().over(Window.partitionBy(*group, "ready", *evidence, "side").orderBy("pos")), "b": sides[0], "a": sides[1]})
        fits = (F.col("b") == 1) & (F.col("a") == 1) if unique else F.col("nth") <= F.least("b", "a")
        fits = F.col("ready") & fits
        slot = F.to_json(F.struct(*[F.col(c) for c in evidence], "nth"))
        rows = rows.withColumns({"slot": F.when(fits, slot).otherwise(F.col("slot")), "pass": F.when(fits, F.lit(number)).otherwise(F.col("pass"))})
    lone = F.when(F.col("pass").isNull(), F.struct("side", "pos", "signature", "body"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    found = rows.withColumn("lone", F.to_json(lone)).groupBy(*group, "pass", "slot", "lone", F.when(F.col("pass").isNull(), F.col("nth")).alias("own"))
    out = [of(side, c).alias(f"{prefix}_{c}") for side, prefix in ((0, "old"), (1, "new")) for c in ("signature", "body", "fingerprint", "pos")]
    return found.agg(*out).drop("slot", "lone", "own")


def change_of() -> F.Column:
    """The kind of change of a row of paired(), null where nothing changed."""
    return (
        F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed")
        .when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "signature_changed").when(~F.col("old_body").eqNullSafe(F.col("new_body")), "body_changed")
    )


def without_failures(changes: DataFrame, failures: DataFrame) -> DataFrame:
    """Changes of files that both versions could parse: a file that failed would report all its entities as removed or added."""
    return changes.join(failures.select("path").distinct(), "path", "left_anti")


def module_changes(changed: DataFrame, changes: DataFrame) -> DataFrame:
    """A module-level change for each changed file(path) in which no named entity changed."""
    return changed.select("path").distinct().join(changes.select("path").distinct(), "path", "left_anti").select("path", F.lit("module").alias("kind"), F.col("path").alias("name"), F.lit("body_changed").alias("change"))


def token_set(text: str | None) -> frozenset[str]:
    out, token = set(), []
    for c in f"{text or ''} ":
        if (c.isascii() and c.isalnum()) or c == "_":
            token.append(c)
        elif token:
            out.add("".join(token))
            token = []
    return frozenset(out)


def similarity(a, b) -> float:
    """1 for equal fingerprints, .97 for equal bodies, else the Jaccard similarity of the signatures' tokens in hundredths."""
    if a["fingerprint"] and a["fingerprint"] == b["fingerprint"]:
        return 1.0
    if a["body"] and a["body"] == b["body"]:
        return 0.97
    left, right = token_set(a["signature"]), token_set(b["signature"])
    union = len(left | right)
    return int(len(left & right) / union * 100 + 0.5) / 100 if union else 1.0


def renames(removed: DataFrame, added: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, kind, old_name, new_name, old_pos, new_pos, similarity): each removed entity of a file, by pos, takes the best added one left.

    Entities(path, kind, name, signature, body, fingerprint, pos). A task holds the removed and added entities of one file and kind."""
    ship_package(removed.sparkSession)

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        left, out = new.sort_values(["pos", "name"]).to_dict("records"), []
        for r in old.sort_values(["pos", "name"]).to_dict("records"):
            best, score = None, 0.0
            for i, a in enumerate(left):
                if (s := similarity(r, a)) > score:
                    best, score = i, s
            if best is not None and score >= threshold:
                a = left.pop(best)
                out.append((r["path"], r["kind"], r["name"], a["name"], r["pos"], a["pos"], score))
        return pd.DataFrame(out, columns=["path", "kind", "old_name", "new_name", "old_pos", "new_pos", "similarity"])

    columns = ["path", "kind", *CONTENT]
    text = lambda df: df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("signature", "body", "fingerprint") else F.col(c) for c in columns])
    return text(removed).groupBy("path", "kind").cogroup(text(added).groupBy("path", "kind")).applyInPandas(run, "path string, kind string, old_name string, new_name string, old_pos long, new_pos long, similarity double")


def move_candidates(removed: DataFrame, added: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(r, a, a_order, score) of entities of one kind in different files that are alike, by equal fingerprints, equal bodies or signatures.

    Entities(id, path, kind, signature, body, fingerprint), ids giving their order. Signatures meet on the rarest tokens that a pair as
    alike as the threshold must share (prefix filtering), never as all pairs of a kind."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce("signature", F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)))
    mark = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "path", "kind", "body", "fingerprint")], tokens.alias(f"{p}_tokens"))
    r, a = materialize(mark(removed, "r"), "removed"), materialize(mark(added, "a"), "added")
    other = (F.col("r_kind") == F.col("a_kind")) & (F.col("r_path") != F.col("a_path"))
    pairs = []
    for c in ("fingerprint", "body"):
        pairs.append(r.filter(f"r_{c} <> ''").join(unbroadcast(a.filter(f"a_{c} <> ''")), other & (F.col(f"r_{c}") == F.col(f"a_{c}"))).select("r_id", "a_id"))
    both = r.select("r_kind", F.explode("r_tokens").alias("token")).unionByName(a.select(F.col("a_kind").alias("r_kind"), F.explode("a_tokens").alias("token")))
    df = both.groupBy("r_kind", "token").count()

    def prefix(side: DataFrame, p: str) -> DataFrame:
        exploded = side.select(f"{p}_id", f"{p}_path", F.col(f"{p}_kind").alias("r_kind"), F.size(f"{p}_tokens").alias("n"), F.explode(f"{p}_tokens").alias("token")).join(unbroadcast(df), ["r_kind", "token"])
        nth = F.row_number().over(Window.partitionBy(f"{p}_id").orderBy("count", "token"))
        # the similarity is rounded to hundredths, so threshold - .005 is what a pair must really reach
        return exploded.withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.lit(threshold - 0.005) * F.col("n") - 1e-9) + 1)

    near = prefix(r, "r").join(unbroadcast(prefix(a, "a").select("a_id", "a_path", "r_kind", "token")), ["r_kind", "token"]).filter("r_path <> a_path")
    pairs.append(near.select("r_id", "a_id"))
    bare = [r.filter("size(r_tokens) = 0").select("r_id", "r_kind", "r_path"), a.filter("size(a_tokens) = 0").select("a_id", "a_kind", "a_path")]
    pairs.append(bare[0].join(unbroadcast(bare[1]), other).select("r_id", "a_id"))
    whole = pairs[0]
    for p in pairs[1:]:
        whole = whole.unionByName(p)
    scored = whole.distinct().join(unbroadcast(r), "r_id").join(unbroadcast(a), "a_id")
    union = F.size(F.array_union("r_tokens", "a_tokens"))
    alike = F.when(union == 0, 1.0).otherwise(F.floor(F.size(F.array_intersect("r_tokens", "a_tokens")) / union * 100 + 0.5) / 100)
    same = lambda c: (F.col(f"r_{c}") != "") & (F.col(f"r_{c}") == F.col(f"a_{c}"))
    score = F.when(same("fingerprint"), 1.0).when(same("body"), 0.97).otherwise(alike)
    return scored.select(F.col("r_id").alias("r"), F.col("a_id").alias("a"), score.alias("score")).filter(F.col("score") >= threshold)


def reconcile_moves(edges: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(r, a, score, ambiguous): in order of r, each takes its best candidate left (ties: least a), none where a second is within `margin`.

    The order is followed without one task seeing all: a round settles every r that is first at each of its candidates, which no
    earlier one can take from it any more. Rounds end when nothing is open; each is written, which cuts its lineage."""
    open_, done = materialize(edges.select("r", "a", "score"), "moves"), None
    while not open_.isEmpty():
        first = open_.groupBy("a").agg(F.min("r").alias("first"))
        ranked = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "a"))
        mine = open_.join(unbroadcast(first), "a").withColumn("nth", ranked).groupBy("r").agg(
            F.bool_and(F.col("first") == F.col("r")).alias("safe"), F.max(F.when(F.col("nth") == 1, F.struct("a", "score"))).alias("best"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("second")
        ).filter("safe")
        unsure = F.coalesce(F.round(F.col("best.score") - F.col("second"), 6) < margin, F.lit(False))
        now = materialize(mine.select("r", F.col("best.a").alias("a"), F.col("best.score").alias("score"), unsure.alias("ambiguous")), "moves-settled")
        done = now if done is None else done.unionByName(now)
        taken = now.filter("not ambiguous").select("a")
        open_ = materialize(open_.join(unbroadcast(now.select("r")), "r", "left_anti").join(unbroadcast(taken), "a", "left_anti"), "moves")
    return edges.select("r", "a", "score", F.lit(False).alias("ambiguous")).limit(0) if done is None else done


def change_text(change, kind, name, old_name=None, old_path=None, dependents=None):
    """One line a change: + added, - removed, ~ otherwise, with the number of dependents of what was there before."""
    n = F.coalesce(dependents, F.lit(0)) if dependents is not None else F.lit(0)
    tail = F.when(n == 1, " (1 dependent)").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(" dependents)")))
    old_name = F.lit(None).cast("string") if old_name is None else old_name
    old_path = F.lit(None).cast("string") if old_path is None else old_path
    moved = F.when(old_name.isNotNull() & (old_name != name), F.concat(name, F.lit(" (renamed from "), old_name, F.lit(")"))).otherwise(name)
    return (
        F.when(change == "added", F.concat_ws(" ", F.lit("+"), kind, name, F.lit("added")))
        .when(change == "removed", F.concat(F.concat_ws(" ", F.lit("-"), kind, name, F.lit("removed")), tail))
        .when(change == "renamed", F.concat(F.concat_ws(" ", F.lit("~"), kind, name, F.lit("renamed from"), old_name), tail))
        .when(change == "moved", F.concat(F.concat_ws(" ", F.lit("~"), kind, moved, F.lit("moved from"), old_path), tail))
        .otherwise(F.concat(F.concat_ws(" ", F.lit("~"), kind, name, F.regexp_replace(change, "_", " ")), tail))
    )
