"""Merkle manifest of a dataset by slot pivot.

Rows are leaves, numbered inside their group by range partitioning.  A level
is raised by one grouping: conditional aggregates spread the children of each
parent into ``FANOUT`` slot columns, and the hash of the concatenated columns
is the parent.  On the way down the columns on both sides of a child's own
slot are its siblings, so a row's proof is the list of (left, right) texts
from its own level to the root.  The last groupings of the leaves still hold
the leaves in their slots, so they are never joined back.

A group of any size is split by position: no task holds more than ``FANOUT``
children of one parent, and the levels above the first are a sixteenth of the
rows.  The groups' roots form a tree of the same kind, in the order of the
groups.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import shared_checkpoint
from tabsight.operators.ordered import ordered_rank

FANOUT = 16
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda cur, x: F.sha2(F.concat(x["left"], cur, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _raised(nodes: DataFrame) -> DataFrame:
    """Parents of (key, pos, n, item) where the key has more than one node:
    (key, pos, n, c0 … c15, digest), n being the key's number of parents."""
    slot = F.col("pos") % FANOUT
    parents = nodes.where("n > 1").groupBy("key", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
        F.ceil(F.max("n") / FANOUT).alias("n"),
        *[F.max(F.when(slot == s, F.col("item"))).alias(f"c{s}") for s in range(FANOUT)])
    return shared_checkpoint(parents.withColumn("digest", F.sha2(F.concat(*_slots()), 256)))


def _slots(first: int = 0, end: int = FANOUT) -> list[Column]:
    return [F.coalesce(F.col(f"c{s}.digest"), F.lit("")) for s in range(first, end)] or [F.lit("")]


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The tables of parents, one for each level above the leaves."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        levels.append(_raised(nodes))
        nodes = levels[-1].select("key", "pos", "n", F.struct("digest").alias("item"))
        most = -(-most // FANOUT)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, height, digest): the one node left of each key."""
    out = nodes.where("n = 1").select("key", F.lit(0).alias("height"), F.col("item.digest").alias("digest"))
    for height, level in enumerate(levels, 1):
        out = out.unionByName(level.where("n = 1").select("key", F.lit(height).alias("height"), "digest"))
    return out


def _children(parents: DataFrame) -> DataFrame:
    """(key, pos, item, path, top) of the children of parents that have a
    path: the slots before and behind a child's own are its siblings."""
    each = F.explode(F.array(*[
        F.struct((F.col("pos") * FANOUT + s).alias("pos"), F.col(f"c{s}").alias("item"),
                 F.concat(*_slots(0, s)).alias("left"), F.concat(*_slots(s + 1)).alias("right"))
        for s in range(FANOUT)]))
    return parents.select("key", "path", "top", each.alias("x")).where("x.item IS NOT NULL").select(
        "key", "x.pos", "x.item", F.concat(F.array(F.struct("x.left", "x.right")), "path").alias("path"), "top")


def _with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, pos, item, path, top) of the leaves; ``tops`` has each key's
    height, path above its top node and ``top``, which is handed down."""
    down = None
    for height in range(len(levels), 0, -1):
        at = tops.where(F.col("height") == height).select("key", F.lit(0).cast("long").alias("pos"), "path", "top")
        if down is not None:
            at = at.unionByName(down.select("key", "pos", "path", "top"))
        down = _children(levels[height - 1].drop("n", "digest").join(at, ["key", "pos"]))
    lone = nodes.where("n = 1").join(tops.where("height = 0").select("key", "path", "top"), "key").select(
        "key", "pos", "item", "path", "top")
    return lone if down is None else down.unionByName(lone)


def merkle_manifest(df: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source",
                    id_col: str = "doc_id", changed: dict[str, Column] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, changed_leaf, subroot, root
    and path (array of left and right sibling texts, from the leaf's level to
    the root; ``fold(leaf, path)`` is the root).

    ``changed`` replaces columns by expressions over ``df``; ``changed_leaf``
    is the leaf of the row so changed, null where it is the same.  Rows with a
    null group form the first group; in a group null ids come first, rows that
    share an id are ordered by their leaf, and equal rows are interchangeable.
    A null or empty field has a digest of its own; an empty table gives no
    row; columns not named in ``fields`` are not read."""
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf = leaf_digest([F.col(c) for c in fields])
    other = leaf_digest([(changed or {}).get(c, F.col(c)) for c in fields])
    rows = shared_checkpoint(df.select(
        group.alias("key"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("other")).select(
        "key", "id", "digest", F.when(F.col("other") != F.col("digest"), F.col("other")).alias("other"),
        F.lit(0).alias("zero")))
    ranked = ordered_rank(rows, ["key"], "zero", ["id", "digest"], partitions)
    nodes = ranked.select("key", (F.col("__rank") - 1).alias("pos"), F.col("__n").alias("n"),
                          F.struct("digest", "id", "other").alias("item"))
    levels = _levels(nodes)
    subroots = shared_checkpoint(_tops(nodes, levels).withColumn("zero", F.lit(0)))
    ranked = ordered_rank(subroots, [], "zero", ["key"], partitions)
    roots = ranked.select(F.lit("").alias("key"), (F.col("__rank") - 1).alias("pos"), F.col("__n").alias("n"),
                          F.struct("digest", F.col("key").alias("group"), "height").alias("item"))
    root_levels = _levels(roots)
    top = _tops(roots, root_levels).first()
    above = _with_paths(roots, root_levels, _tops(roots, root_levels).select(
        "key", "height", F.array().cast(PATH).alias("path"), F.col("digest").alias("top")))
    tops = shared_checkpoint(above.select(F.col("item.group").alias("key"), F.col("item.height").alias("height"), "path",
                                          F.col("item.digest").alias("top")))
    return _with_paths(nodes, levels, tops).select(
        F.col("item.id").alias("doc_id"), F.col("item.digest").alias("leaf"), F.col("item.other").alias("changed_leaf"),
        F.col("top").alias("subroot"), F.lit(top["digest"] if top else None).cast("string").alias("root"), "path")


def verified_manifest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 5) -> DataFrame:
    """The manifest's digests with a tampering test: where ``every`` divides
    the CRC-32 of the id as text, the text's A-Z are lower-cased (a null id
    has no CRC-32, so such a row is not tampered with), and the leaf so
    changed is folded with the original siblings."""
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    text = F.when(tampered, lower_ascii(F.col(text_col).cast("string"))).otherwise(F.col(text_col).cast("string"))
    out = merkle_manifest(df, id_col=id_col, changed={text_col: text})
    folded = fold(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
