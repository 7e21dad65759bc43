"""A Merkle manifest: one digest for a dataset, and for each row a proof that leads to it.

Nodes are kept in tables, one folder per level and tree, and each level is made from the one below it alone. Leaves
are put in order in sorted runs of their digests (see `ordering`); from then on a node is known by its coordinate, its tree
and place in its level, and sixteen consecutive places make a node of the next level. Proofs are read back from the
top: the runs of a level meet the paths of the nodes above them by merge joins on coordinates, sixteen times fewer rows
than the level has, so only the last join is as long as a sixteenth of the leaves. No task holds more than its
share of a level, and the driver sees nothing but the greatest count of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ordering import ALL, POS, placed

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as its count of bytes, a colon and itself; null as a dash."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(fields: tuple[str, ...], text: str, told: Column | None = None) -> Column:
    return sha(F.concat(*[field(told if told is not None and c == text else F.col(c)) for c in fields]))


def runs_of(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """The sixteen (or fewer) nodes of each run, in order, as `nodes`. Columns of `kept` go along with each node."""
    each = F.struct(F.col(POS), "digest", *kept)
    return nodes.groupBy("tree", "n", F.floor(F.col(POS) / FANOUT).cast("long").alias("run")).agg(F.array_sort(F.collect_list(each)).alias("nodes"))


def folded(nodes: Column) -> Column:
    return sha(F.array_join(F.transform(nodes, lambda x: x["digest"]), ""))


def grow(leaves: DataFrame, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and the top: tree and digest.

    leaves: tree, n (leaves of the tree), `__pos`, digest and the columns of `kept`. A tree of one leaf has no run; its
    top is the leaf.
    """
    levels, tops = [], [leaves.where("n = 1").select("tree", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    now, width, extra = leaves, 1, kept
    while width < most:
        runs = cut(runs_of(now.where(F.col("n") > width), extra))
        levels.append(runs)
        now = runs.select("tree", "n", F.col("run").alias(POS), folded(F.col("nodes")).alias("digest"))
        tops.append(now.where(F.col("n").between(width + 1, width * FANOUT)).select("tree", "digest"))
        width, extra = width * FANOUT, []
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, cut(top)


def steps(nodes: Column) -> Column:
    """Each node of a run with its siblings to the left and to the right, joined."""
    def beside(_, i):
        digest = F.transform(nodes, lambda x: x["digest"])
        return F.struct(F.array_join(F.slice(digest, 1, i), "").alias("left"), F.array_join(F.slice(digest, i + 2, FANOUT), "").alias("right"))

    return F.transform(nodes, beside)


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level, each with the path from it up to the root: tree, `node` (its struct), `path`
    and what `above` says of its tree's top (tree, top, path). Trees of one leaf are not among them."""
    known = None  # tree, place, top and path of the nodes of the level above
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k].withColumn("__top", F.col("n") <= FANOUT ** (k + 1))  # the run folds to its tree's top
        ends = runs.where("__top").join(above, "tree")
        if known is not None:
            ends = ends.unionByName(runs.where("NOT __top").join(known.withColumnRenamed(POS, "run"), ["tree", "run"]))
        both = F.zip_with("nodes", steps(F.col("nodes")), lambda node, step: F.struct(node.alias("node"), step.alias("step")))
        each = ends.select("tree", "top", F.col("path").alias("__path"), F.explode(both).alias("x"))
        found = each.select("tree", F.col("x.node").alias("node"), "top", F.concat(F.array("x.step"), "__path").alias("path"))
        known = cut(found.select("tree", F.col(f"node.{POS}").alias(POS), "top", "path")) if k else found
    return known


def ranked(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """Leaves with their place in their tree and its count of leaves, as `grow` takes them."""
    return cut(placed(leaves, [F.col("tree"), *order], ("tree",)).withColumnRenamed(ALL, "n"))


def with_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, kept: list[str]) -> DataFrame:
    """tree, node, top and path of every leaf of every tree, a lone leaf's path being that of its tree."""
    lone = leaves.where("n = 1").select("tree", F.struct(F.col(POS), "digest", *kept).alias("node")).join(above, "tree").select("tree", "node", "top", "path")
    return lone.unionByName(paths(levels, above)) if levels else lone


def fold_path(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text", tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """One row per input row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's fields. Per group leaves ascend by key (null first; rows that repeat a
    key by their digest), and sixteen consecutive nodes become one until one is left, the subroot. Subroots, null group
    first and then by their bytes, become the root in the same way. The proof is a leaf's siblings, level by level
    up to the root. tampered: a condition under which the proof is asked of a changed text (`changed`, by default with A-Z
    in lower case); folded_root is what the proof then leads to, and verified whether that is the root. A null text stays null.
    Equal rows have one leaf and are interchangeable. An empty table gives no rows. Columns that are not
    among the fields are ignored.
    """
    if tampered is None:
        tampered = F.lit(False)
    if changed is None:
        changed = F.translate(text, UPPER, LOWER)
    rows = docs.select(F.col(key).alias("__key"), *[c for c in fields if c != key], *([F.col(key)] if key in fields else []), *([group] if group not in fields and group != key else []))
    rows = rows.withColumn("digest", leaf_digest(fields, text))
    shown = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(fields, text, changed)).otherwise(F.col("digest"))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all, as bytes
    leaves = cut(rows.select(tree.alias("tree"), "__key", "digest", shown.alias("shown")))
    leaves = ranked(leaves, [F.col("__key").asc_nulls_first(), F.col("digest")])
    low, subroots = grow(leaves, ["__key", "shown"])
    tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), [F.col("of")])
    high, root = grow(tops, ["of"])
    above = with_paths(tops, high, root.select("tree", F.col("digest").alias("top"), F.array().cast(PATH).alias("path")), ["of"])
    above = cut(above.select(F.col("node.of").alias("tree"), F.struct(F.col("node.digest").alias("subroot"), F.col("top").alias("root")).alias("top"), "path"))
    found = with_paths(leaves, low, above, ["__key", "shown"])
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = found.select(F.col("node.__key").alias(key), F.col("node.digest").alias("leaf"), "top.subroot", "top.root", sha(proof).alias("proof_sha256"), fold_path(F.col("node.shown"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
