"""Merkle manifest of a dataset: aligned builders append nodes in postorder, proofs are read back.

A tree joins every three consecutive nodes of a level (the last run may be
shorter, even one) until one node is left. Its nodes are logged in the order in
which they complete: a node right after the last of its leaves and of the nodes
below it. So leaf ``i`` stands at ``i + i div 3 + i div 9 + ...``, which is
``(3 i - s) / 2`` with ``s`` the sum of the base-3 digits of ``i``, and the node
at level ``k`` whose last leaf is ``i`` stands ``k`` places after that leaf.
Siblings are read from the log at such places; no pointers are stored.

A builder takes an aligned block of up to ``3 ** HEIGHT`` nodes of one level. The
tops of the blocks are the nodes of the next round, so a tree of any size, a hot
source too, is built and read in groups of bounded size. The roots of the trees,
in the order of their names, are the leaves of one more tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, written
from labelcorr.session import broadcast_if_small

ARITY = 3
HEIGHT = 8  # levels of a builder: at most 6,561 nodes of a level in a group
MAX_PARTS = 20_000  # rows of (partition, tree) that may be broadcast
POSITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


@dataclass(frozen=True)
class Round:
    """One round: its nodes ``(tree, idx, size, digest, ...)`` and logs ``(tree, block, log)``."""

    nodes: DataFrame
    logs: DataFrame


@dataclass(frozen=True)
class Manifest:
    """The rounds of the trees, then those of the tree of their roots; tables in the shared folder."""

    rounds: tuple[Round, ...]
    tops: DataFrame  # (tree, digest, rank): the root of each tree and its place
    over: tuple[Round, ...]
    root: str | None  # None without rows


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def digest(*values: Column) -> Column:
    """SHA-256 of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def manifest(leaves: DataFrame, id_col: str = "id", tree_col: str = "tree") -> Manifest:
    """Build the trees of ``leaves (id, tree, leaf, ...)``, a row per leaf.

    Leaves ascend by id in their tree, a null id first; rows with the same id
    stand in the order of their leaves, and equal ones may trade places, which
    changes nothing. A null tree is a tree of its own and comes first. Other
    columns are carried along. An empty table has no trees and no root.
    """
    name = F.coalesce(F.concat(F.lit("+"), F.col(tree_col).cast("string")), F.lit(""))
    rest = [c for c in leaves.columns if c not in (id_col, tree_col, "leaf")]
    named = leaves.select(
        name.alias("tree"), F.col("leaf").alias("digest"), F.col(id_col).alias("id"), *rest
    )
    nodes = written(_ranked(written(named, "leaves"), "id", "digest"), "ranked")
    rounds, tops = _grown(nodes)
    ranked = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    ranked = written(_ranked(ranked, "name"), "trees")
    over, top = _grown(ranked)
    found = top.first()
    tops = ranked.select(F.col("name").alias("tree"), "digest", F.col("idx").alias("rank"))
    return Manifest(rounds, tops, over, bytes(found["digest"]).hex() if found else None)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``idx``, the place in the tree by ``order``, and ``size``, the number of its rows.

    Rows are dealt by ranges of tree and order, so a tree with a third of all
    rows is spread too. A row's place is its position in its partition plus the
    tree's rows in earlier partitions, of which only the counts are gathered.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    placed = written(
        placed.select(
            "*", F.spark_partition_id().alias("_part"), at.bitwiseAND(POSITION).alias("_at")
        ),
        "placed",
    )
    parts = placed.groupBy("_part", "tree").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        "tree",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    found = placed.join(broadcast_if_small(parts, MAX_PARTS), ["_part", "tree"])
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _grown(nodes: DataFrame) -> tuple[tuple[Round, ...], DataFrame]:
    """The rounds over ``nodes (tree, idx, size, digest)`` and the roots ``(tree, digest)``."""
    rounds: list[Round] = []
    width = ARITY**HEIGHT
    while True:
        rows = nodes.select("tree", "idx", "size", "digest", F.expr(f"idx div {width}").alias("block"))
        logs = rows.groupBy("tree", "block").applyInArrow(
            _built, "tree string, block long, size long, log binary, top binary"
        )
        logs = written(logs, "log")
        rounds.append(Round(nodes, logs))
        tops = logs.select("tree", F.col("block").alias("idx"), "size", F.col("top").alias("digest"))
        if logs.filter(F.col("size") > 1).isEmpty():
            return tuple(rounds), tops.select("tree", "digest")
        nodes = tops


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    """The log of a block, in postorder, and its top; ``size`` is now the number of blocks."""
    rows = rows.sort_by("idx")
    tree, block = (k.as_py() for k in key)
    size = rows["size"][0].as_py()
    log, top = postorder(rows["digest"].to_pylist(), levels(size))
    return pa.table(
        {
            "tree": pa.array([tree], pa.string()),
            "block": pa.array([block], pa.int64()),
            "size": pa.array([-(-size // ARITY**HEIGHT)], pa.int64()),
            "log": pa.array([b"".join(log)], pa.binary()),
            "top": pa.array([top], pa.binary()),
        }
    )


def levels(size: int) -> int:
    """Levels above the nodes of a block, in a tree with ``size`` nodes at that level."""
    height = 0
    while height < HEIGHT and ARITY**height < size:
        height += 1
    return height


def joined(nodes: list[bytes]) -> bytes:
    """The digest of a run of digests, as hex text."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def postorder(leaves: list[bytes], height: int) -> tuple[list[bytes], bytes]:
    """All nodes of a block in the order in which they complete, and the last one."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(node: bytes, level: int, last: bool) -> None:
        log.append(node)
        open_runs[level].append(node)
        if level < height and (last or len(open_runs[level]) == ARITY):
            run, open_runs[level] = open_runs[level], []
            add(joined(run), level + 1, last)

    for i, leaf in enumerate(leaves):
        add(leaf, 0, i == len(leaves) - 1)
    return log, log[-1]


def position(i: int) -> int:
    """Where leaf ``i`` stands in the log."""
    digits, rest = 0, i
    while rest:
        rest, digit = divmod(rest, ARITY)
        digits += digit
    return (ARITY * i - digits) // (ARITY - 1)


def siblings(i: int, n: int, height: int) -> list[tuple[list[int], list[int]]]:
    """Per level, where the other nodes of leaf ``i``'s run stand: left of it, right of it."""
    found, at, count, span = [], i, n, 1
    for level in range(height):
        first = at - at % ARITY
        places = [
            position(min((j + 1) * span, n) - 1) + level
            for j in range(first, min(first + ARITY, count))
        ]
        found.append((places[: at - first], places[at - first + 1 :]))
        at, count, span = at // ARITY, -(-count // ARITY), span * ARITY
    return found


def proofs(made: Manifest) -> DataFrame:
    """The leaves with ``subroot`` and ``path``, from the rounds' logs, top round first.

    ``path`` has per level a byte ``3 left + right`` with the numbers of
    siblings on either side, and their digests from left to right.
    """
    if made.root is None:
        return made.rounds[0].nodes.withColumns({"subroot": F.lit(b""), "path": F.lit(b"")})
    paths = None
    for step in reversed(made.over):
        paths = _paths(step, paths)
    ranked = paths.select(F.col("idx").alias("rank"), F.col("path"))
    tops = made.tops.join(ranked, "rank").select(
        "tree", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "path"
    )
    paths = written(tops, "paths")
    for step in reversed(made.rounds):
        paths = _paths(step, paths)
    return paths


def _paths(step: Round, above: DataFrame | None) -> DataFrame:
    """``step``'s nodes with their paths; ``above`` has those of the blocks' tops."""
    width = ARITY**HEIGHT
    logs = step.logs.select("tree", "block", "log")
    if above is None:
        logs = logs.withColumns({"subroot": F.lit(b""), "path": F.lit(b"")})
    else:
        logs = logs.join(
            above.select("tree", F.col("idx").alias("block"), "subroot", "path"), ["tree", "block"]
        )
    nodes = step.nodes.drop("subroot", "path")
    schema = nodes.withColumns({"subroot": F.lit(b""), "path": F.lit(b"")}).schema
    names = nodes.columns
    nodes = nodes.withColumn("block", F.expr(f"idx div {width}"))

    def read(key: tuple, rows: pa.Table, log: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n, height = rows.num_rows, levels(rows["size"][0].as_py())
        nodes, rest = log["log"][0].as_py(), log["path"][0].as_py()
        paths = []
        for i in range(n):
            parts = []
            for left, right in siblings(i, n, height):
                parts.append(bytes([ARITY * len(left) + len(right)]))
                parts += [nodes[32 * p : 32 * p + 32] for p in (*left, *right)]
            paths.append(b"".join(parts) + rest)
        told = rows.select(names)
        told = told.append_column("subroot", pa.array([log["subroot"][0].as_py()] * n, pa.binary()))
        return told.append_column("path", pa.array(paths, pa.binary()))

    return (
        nodes.groupBy("tree", "block")
        .cogroup(logs.groupBy("tree", "block"))
        .applyInArrow(read, schema)
    )


def folded(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its siblings give, and the digest of the siblings."""
    at, node, seen = 0, leaf, []
    while at < len(path):
        left, right = divmod(path[at], ARITY)
        nodes = [path[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(left + right)]
        seen += nodes
        node = joined([*nodes[:left], node, *nodes[left:]])
        at += 1 + 32 * (left + right)
    return node, joined(seen)


def checked(proved: DataFrame, claimed: str, root: str | None) -> DataFrame:
    """Add ``proof_sha256``, ``folded_root`` (of the ``claimed`` leaf, or where that is
    null of the row's own) and ``verified`` to rows with paths; digests become hex text."""
    keep = [c for c in proved.columns if c not in ("path", "digest", claimed)]
    rows = proved.select(
        F.coalesce(claimed, "digest").alias("_claimed"), F.col("path").alias("_path"),
        *keep, F.lower(F.hex("digest")).alias("leaf"),
    )
    rows = rows.withColumn("subroot", F.lower(F.hex("subroot")))
    told = rows.drop("_claimed", "_path")
    schema = told.withColumns({"proof_sha256": F.lit(""), "folded_root": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [folded(leaf, path) for leaf, path in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    pa.array([proof.hex() for _, proof in found], pa.string()),
                    pa.array([node.hex() for node, _ in found], pa.string()),
                ],
                schema.names,
            )

    found = arrow_rows(rows, run, schema)
    return found.withColumns(
        {"root": F.lit(root).cast("string"), "verified": F.col("folded_root").eqNullSafe(root)}
    )


def document_leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tree, leaf, tampered)`` of every row, in one pass over the texts.

    A leaf is the digest of id, source, lang, n_chars and the whole text.
    ``tampered`` is the leaf without the line feeds of the text, where the CRC-32
    of the id is even, else null; a null id is not tampered with.
    """
    first = [F.col(c) for c in (id_col, "source", "lang", "n_chars")]
    text = F.col(text_col)
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return docs.select(
        F.col(id_col).alias("id"),
        F.col("source").alias("tree"),
        digest(*first, text).alias("leaf"),
        F.when(even, digest(*first, F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )
