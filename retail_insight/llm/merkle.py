"""Merkle manifest of a dataset: aligned builders append nodes as they are completed.

Leaves are numbered per tree by a global sort. A builder takes ``BLOCK``
neighbouring leaves whose first number is a multiple of ``BLOCK``, hence whole
subtrees, and appends every node to its log when its last child is there: a
postorder. Where a node stands in such a log follows from its level and index
alone, so proofs read their siblings by address; no tree is walked. The
blocks' roots are the leaves of the next tier, until one block holds a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.ordering import ranked
from retail_insight.sources.workspace import stage

LEVELS = 12
BLOCK = 1 << LEVELS


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def node_hash(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """The nodes of one aligned block in the order of their completion.

    Every two neighbours have a parent; a last one alone has its own. The last
    node of the log is the root, ``levels`` above the leaves.
    """
    log: list[str] = []
    waiting: list[str | None] = [None] * (levels + 1)
    for node in leaves:
        level = 0
        log.append(node)
        while level < levels and (left := waiting[level]) is not None:
            node, waiting[level] = node_hash([left, node]), None
            log.append(node)
            level += 1
        waiting[level] = node
    last = None
    for level in range(levels):
        run = [x for x in (waiting[level], last) if x is not None]
        if run:
            last = node_hash(run)
            log.append(last)
    return log


def log_place(level: int, index: int, leaves: int) -> int:
    """Where node ``index`` of a level stands in the log of a block of so many leaves.

    A full subtree ending at leaf e comes after the 2(e-1) - popcount(e-1)
    nodes that e-1 leaves complete, and after its last path's lower nodes. The
    nodes of the ragged right edge follow all full ones, level by level.
    """
    end = (index + 1) << level
    if end <= leaves:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    full_below = (leaves & -leaves).bit_length() - 1  # the levels at which no node is ragged
    return 2 * leaves - leaves.bit_count() + level - 1 - full_below


def block_levels(size: int) -> int:
    """Levels above the leaves of a block, from the number of nodes of its whole tier."""
    return LEVELS if size > BLOCK else max(size - 1, 0).bit_length()


def sibling_paths(log: list[str], leaves: int, levels: int) -> Iterator[list[str]]:
    """For every leaf its siblings upwards: ``L`` or ``R`` for the side, then the hash; empty for none."""
    rows = []
    for level in range(levels):
        width = -(-leaves >> level)
        rows.append([log[log_place(level, k, leaves)] for k in range(width)])
    for leaf in range(leaves):
        path = []
        for level, row in enumerate(rows):
            other = (leaf >> level) ^ 1
            side = "R" if other & 1 else "L"
            path.append(side + row[other] if other < len(row) else "")
        yield path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        leaf = node_hash([leaf] if not step else [leaf, step[1:]] if step[0] == "R" else [step[1:], leaf])
    return leaf


@dataclass
class Manifest:
    """``tiers``: one row a block (tree, block, size, ids, claims, log, root), leaves first; ``top``: the tiers over the trees' roots."""

    tiers: list[DataFrame]
    top: list[DataFrame]

    def subroots(self) -> DataFrame:
        """``tree`` and ``root`` of every tree."""
        return _finished(self.tiers)

    def root(self) -> str | None:
        """The hash that stands for the whole dataset; None if it has no rows."""
        row = _finished(self.top).select("root").first()
        return row and row.root


def _finished(tiers: list[DataFrame]) -> DataFrame:
    done = [t.where(F.col("size") <= BLOCK).select("tree", "root") for t in tiers]
    return reduce(DataFrame.unionAll, done)


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row a block from rows of tree, position, size, id, leaf and claim."""
    id_type = nodes.schema["id"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["position"].to_numpy())
        table = table.take(pa.array(order))
        size = table["size"][0].as_py()
        log = append_log(table["leaf"].to_pylist(), block_levels(size))
        claims = table["claim"].combine_chunks()
        return pa.table(
            {
                "tree": table["tree"].slice(0, 1),
                "block": table["block"].slice(0, 1),
                "size": table["size"].slice(0, 1),
                "ids": pa.array([table["id"].to_pylist()], pa.list_(table.schema.field("id").type)),
                "claims": pa.array([claims.to_pylist()], pa.list_(pa.string())),
                "log": pa.array([bytes.fromhex("".join(log))], pa.binary()),
                "root": pa.array([log[-1]], pa.string()),
            }
        )

    return (
        nodes.withColumn("block", F.shiftright("position", LEVELS))
        .groupBy("tree", "block")
        .applyInArrow(
            build,
            f"tree string, block long, size long, ids array<{id_type}>, claims array<string>, log binary, root string",
        )
    )


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks over the nodes, the blocks over those blocks' roots, and so on until each tree has one."""
    tiers = [stage(_blocks(nodes), "merkle")]
    while (tiers[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
        roots = tiers[-1].where(F.col("size") > BLOCK)
        upper = roots.select(
            "tree",
            F.col("block").alias("position"),
            F.shiftright(F.col("size") + (BLOCK - 1), LEVELS).alias("size"),
            F.col("block").alias("id"),
            F.col("root").alias("leaf"),
            F.lit(None).cast("string").alias("claim"),
        )
        tiers.append(stage(_blocks(upper), "merkle"))
    return tiers


def build_manifest(
    docs: DataFrame,
    fields: list[str],
    tree: str = "lang",
    doc_id: str = "doc_id",
    claimed: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of all rows: a tree for each value of ``tree``, and one over their roots.

    A leaf is the hash of the row's ``fields``, each encoded with its length,
    so that no two rows read alike. Leaves of a tree ascend by ``doc_id``, null
    ids first; rows with the same id go by their leaf, and equal rows each have
    a leaf of their own. Trees go by the bytes of their value, null first.
    ``claimed`` gives columns that someone claims to hold instead of the stored
    ones; the leaf made of them is kept beside the stored one, to be proved.
    Texts are hashed whole, in one pass; a null field is ``-``, an empty one
    ``0:``. Other columns are not read, whatever their names. No rows give a
    manifest without a root.

    No task holds more than a block: a tree of any size is split by its
    numbering, and each tier is ``BLOCK`` times smaller than the one below. The
    driver reads one number a tier.
    """
    stated = [F.col(c) for c in fields]
    other = [(claimed or {}).get(c, F.col(c)) for c in fields]
    hashed = docs.select(
        F.concat(F.lit("="), F.col(tree).cast("string")).alias("tree"),
        F.col(doc_id).alias("id"),
        F.sha2(F.concat(*map(encoded, stated)), 256).alias("leaf"),
        F.sha2(F.concat(*map(encoded, other)), 256).alias("claim") if claimed else F.lit(None).cast("string").alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    changed = F.when(F.col("claim") != F.col("leaf"), F.col("claim"))
    leaves = stage(hashed.withColumns({"tree": F.coalesce("tree", F.lit("")), "claim": changed}), "leaves")
    nodes = ranked(leaves, "tree", ["id", "leaf", "row"]).withColumnRenamed("group_rows", "size").drop("row")
    tiers = _tiers(nodes)
    roots = _finished(tiers).select(
        F.lit("").alias("tree"),
        F.col("tree").alias("id"),
        F.col("root").alias("leaf"),
        F.lit(None).cast("string").alias("claim"),
    )
    top = ranked(stage(roots, "subroots"), "tree", ["id"]).withColumnRenamed("group_rows", "size")
    return Manifest(tiers, _tiers(top))


def _walk(tiers: list[DataFrame], above: DataFrame, proofs) -> DataFrame:
    """Hand the path above each block down the tiers; ``proofs`` turns the lowest blocks into rows.

    ``above`` has tree, root, and ``path``: the steps from the tree's root upwards.
    """
    paths = None
    for number, tier in reversed(list(enumerate(tiers))):
        ready = tier.where(F.col("size") <= BLOCK).join(above, "tree")
        if paths is not None:
            ready = ready.unionByName(tier.where(F.col("size") > BLOCK).join(paths, ["tree", "block"]))
        if number == 0:
            return proofs(ready)
        paths = stage(_steps(ready, "long").withColumnRenamed("id", "block"), "paths")
    raise ValueError("a manifest has at least one tier")


def _opened(row: dict) -> tuple[list[str], list[list[str]]]:
    """The leaves of a block and their paths to the root of everything."""
    count, nodes = len(row["ids"]), row["log"].hex()
    log = [nodes[k : k + 64] for k in range(0, len(nodes), 64)]
    inside = sibling_paths(log, count, block_levels(row["size"]))
    leaves = [log[log_place(0, k, count)] for k in range(count)]
    return leaves, [path + row["path"] for path in inside]


def _steps(blocks: DataFrame, id_type: str) -> DataFrame:
    """``tree``, ``id``, ``subroot``, ``whole`` and ``path`` for every leaf of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                paths, count = _opened(row)[1], len(row["ids"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * count, pa.string()),
                        pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                        pa.array([row["subroot"]] * count, pa.string()),
                        pa.array([row["whole"]] * count, pa.string()),
                        pa.array(paths, pa.list_(pa.string())),
                    ],
                    names=["tree", "id", "subroot", "whole", "path"],
                )

    slim = blocks.select("tree", "size", "ids", "log", "subroot", "whole", "path")
    return slim.mapInArrow(run, f"tree string, id {id_type}, subroot string, whole string, path array<string>")


def prove(manifest: Manifest) -> DataFrame:
    """A proof of every leaf, folded from what is claimed.

    ``doc_id``, ``leaf``, ``subroot`` and ``root`` as built; ``proof``, the hex
    digests of the siblings from the leaf's to the highest tree's, in one
    string; and ``folded_root``, to which the claimed leaf (the stored one, if
    nothing else is claimed) and these siblings lead. Repeated rows each come out.
    """
    none = F.array().cast("array<string>")
    whole = _finished(manifest.top).select("tree", F.col("root").alias("subroot"), F.col("root").alias("whole"), none.alias("path"))
    upper = _walk(manifest.top, whole, lambda ready: _steps(ready, "string"))
    above = stage(upper.select(F.col("id").alias("tree"), F.col("whole"), "path"), "paths")
    above = above.join(manifest.subroots().withColumnRenamed("root", "subroot"), "tree")
    id_type = manifest.tiers[0].schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                leaves, paths = _opened(row)
                shown = [claim or leaf for claim, leaf in zip(row["claims"], leaves, strict=True)]
                count = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                        pa.array(leaves, pa.string()),
                        pa.array([row["subroot"]] * count, pa.string()),
                        pa.array([row["whole"]] * count, pa.string()),
                        pa.array(["".join(step[1:] for step in path) for path in paths], pa.string()),
                        pa.array(map(fold, shown, paths), pa.string()),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"],
                )

    def proofs(ready: DataFrame) -> DataFrame:
        slim = ready.select("size", "ids", "claims", "log", "subroot", "whole", "path")
        return slim.mapInArrow(
            run, f"doc_id {id_type}, leaf string, subroot string, root string, proof string, folded_root string"
        )

    return _walk(manifest.tiers, above, proofs)
