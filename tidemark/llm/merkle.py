"""Merkle dataset manifest with SHA midstates (operator 12).

Each row is a leaf; the leaves of a language, by ``doc_id``, are the lowest
level of a tree in which every ``arity`` consecutive nodes have a parent, also
a last run of fewer. The roots of the languages make a tree in the same way.

A parent is hashed child by child, and the hash state is copied before each
child slot. Putting another child into a slot resumes the state kept for it,
takes the replacement and then only the siblings to the right.

A tree is cut into blocks of ``arity ** levels`` nodes; a task builds a block
and keeps its states, and the block's root is a node of the next round. Then,
from the top down, each block gets the siblings on its way to the root, once
for all of its nodes. No tree has a task of its own, however many leaves it has.

Leaves hash doc_id, source, lang, n_chars and text: ``-`` for null, else the
UTF-8 byte count, ``:`` and the value. Rows without ``lang`` are a tree of
their own, the first one; within a tree null ids come first, and equal ids are
ordered by their leaf. Repeated rows are leaves each. A single leaf is its
subroot, a single subroot the root, and the digest of no siblings is that of
the empty string. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import small_batches
from tidemark.llm.ordering import places
from tidemark.session import settle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "tree bigint, n bigint, place bigint, digest string"
#: Siblings to the left and right of each node on the way up.
WAY = "array<struct<left:array<string>,right:array<string>>>"
WAY_TYPE = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Shape:
    """``levels``: of a block; its nodes are bounded by ``arity ** levels``."""

    arity: int = 2
    levels: int = 12

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def height(self, n: int) -> int:
        h, nodes = 0, 1
        while nodes < n:
            h, nodes = h + 1, nodes * self.arity
        return h


class Block:
    """Part of a tree in one task: nodes level by level, and before each the parent's hash state."""

    def __init__(self, digests: list[str], arity: int, levels: int):
        self.arity, nodes = arity, [d.encode() for d in digests]
        self.nodes, self.states = [], []
        for _ in range(levels):
            states, parents = [], []
            for at in range(0, len(nodes), arity):
                parent = hashlib.sha256()
                for child in nodes[at : at + arity]:
                    states.append(parent.copy())
                    parent.update(child)
                parents.append(parent.hexdigest().encode())
            self.nodes.append(nodes)
            self.states.append(states)
            nodes = parents
        (self.root,) = nodes

    def siblings(self, place: int) -> list[tuple[list[bytes], list[bytes]]]:
        """Left and right siblings of a node and of those above it, level by level."""
        out = []
        for nodes in self.nodes:
            at = place - place % self.arity
            out.append((nodes[at:place], nodes[place + 1 : at + self.arity]))
            place //= self.arity
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """Root of the block with another digest in a place."""
        for nodes, states in zip(self.nodes, self.states):
            parent = states[place].copy()
            parent.update(digest)
            for right in nodes[place + 1 : place - place % self.arity + self.arity]:
                parent.update(right)
            digest, place = parent.hexdigest().encode(), place // self.arity
        return digest


class Way:
    """The nodes above a block: hash states after their left siblings, kept for all that is folded through."""

    def __init__(self, steps: list[dict]):
        self.steps, self.siblings = [], b""
        for step in steps:
            state = hashlib.sha256("".join(step["left"]).encode())
            self.steps.append((state, "".join(step["right"]).encode()))
            self.siblings += "".join(step["left"] + step["right"]).encode()
        self.known: dict[bytes, str] = {}

    def fold(self, digest: bytes) -> str:
        if digest not in self.known:
            at = digest
            for state, right in self.steps:
                parent = state.copy()
                parent.update(at)
                parent.update(right)
                at = parent.hexdigest().encode()
            self.known[digest] = at.decode()
        return self.known[digest]


def _block_of(table: pa.Table, shape: Shape, height_done: int) -> tuple[Block, list[int]]:
    """The block of a group's rows, sorted by place, and the place of each within it."""
    left = shape.height(table.column("n")[0].as_py()) - height_done
    block = Block(table.column("digest").to_pylist(), shape.arity, min(shape.levels, max(0, left)))
    return block, [p % shape.block for p in table.column("place").to_pylist()]


def _up(shape: Shape, height_done: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, _ = _block_of(table.sort_by("place"), shape, height_done)
        return pa.table({"tree": table.column("tree")[:1], "n": table.column("n")[:1], "place": pa.array([key[1].as_py()], pa.int64()), "digest": [block.root.decode()]})

    return work


def _down(shape: Shape, height_done: int):
    """Ways of a block's nodes: their siblings in the block, then the block's own way."""

    def work(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block, at = _block_of(table, shape, height_done)
        upper = above.column("way")[0].as_py()
        ways = [[{"left": [x.decode() for x in a], "right": [x.decode() for x in b]} for a, b in block.siblings(k)] + upper for k in at]
        return pa.table({"tree": table.column("tree"), "place": table.column("place"), "way": pa.array(ways, WAY_TYPE)})

    return work


def _blocked(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / shape.block))


def rounds(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """Nodes (``NODE``) of each round of blocks; the last has one node a tree. The first round is ``nodes`` itself."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        work = _up(shape, (len(out) - 1) * shape.levels)
        out.append(settle(_blocked(out[-1], shape).groupBy("tree", "block").applyInArrow(work, NODE)))
        most = -(-most // shape.block)
    return out


def ways_down(rows: list[DataFrame], top: DataFrame, shape: Shape, least: int) -> DataFrame:
    """Ways (tree, place, way) of the nodes of round ``least``, from those of the last round."""
    ways = top
    for k in range(len(rows) - 2, least - 1, -1):
        blocks = _blocked(rows[k], shape).groupBy("tree", "block")
        above = ways.withColumnRenamed("place", "block").groupBy("tree", "block")
        ways = settle(blocks.cogroup(above).applyInArrow(_down(shape, k * shape.levels), f"tree bigint, place bigint, way {WAY}"))
    return ways


def _prove(shape: Shape, table: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a block."""
    table = table.sort_by("place")
    block, at = _block_of(table, shape, 0)
    way = Way(above.column("way")[0].as_py())
    root, proofs, folded = above.column("root")[0].as_py(), [], []
    for place, other in zip(at, table.column("other").to_pylist()):
        proof = hashlib.sha256(b"".join(x for left, right in block.siblings(place) for x in (*left, *right)))
        proof.update(way.siblings)
        proofs.append(proof.hexdigest())
        folded.append(way.fold(block.fold(place, other.encode())))
    n = table.num_rows
    return pa.table(
        {
            "doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([above.column("subroot")[0].as_py()] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def leaf(docs: DataFrame, **changed: Column) -> Column:
    """Digest of a row over its framed fields, some of them changed."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def merkle_proofs(leaves: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Roots, proofs and folds of ``leaves`` (lang, doc_id, leaf, other): ``other`` is the digest to fold with the leaf's siblings."""
    shape = shape or Shape()
    small_batches(leaves.sparkSession)
    rows = settle(leaves.select("lang", "doc_id", F.col("leaf").alias("digest"), "other").withColumn("seq", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("other"), F.asc("seq")]
    placed = places(rows, order, "at")
    trees = settle(placed.groupBy("lang").agg(F.min("at").alias("tree"), F.count("*").alias("n")))
    named = trees.withColumnRenamed("lang", "tree_lang")
    nodes = placed.join(named, placed["lang"].eqNullSafe(named["tree_lang"])).withColumn("place", F.col("at") - F.col("tree"))
    nodes = settle(nodes.select("tree", "n", "place", "digest", "doc_id", "other"))
    lower = rounds(nodes.select("tree", "n", "place", "digest"), shape)
    subroots = lower[-1].select("tree", F.col("digest").alias("subroot"))
    n_trees = subroots.count()
    top = places(subroots, [F.asc("tree")], "place").select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("n"), "place", F.col("subroot").alias("digest"), F.col("tree").alias("named")
    )
    top = settle(top)
    upper = rounds(top.select("tree", "n", "place", "digest"), shape)
    start = upper[-1].select("tree", "place", F.expr(f"cast(array() as {WAY})").alias("way"))
    tops = ways_down(upper, start, shape, 0).drop("tree")
    start = top.join(tops, "place").select(F.col("named").alias("tree"), F.lit(0).cast("bigint").alias("place"), "way")
    ways = ways_down(lower, start, shape, 1) if len(lower) > 1 else start
    root = upper[-1].select(F.col("digest").alias("root"))
    above = ways.join(subroots, "tree").crossJoin(F.broadcast(root)).withColumnRenamed("place", "block")  # one row
    groups = _blocked(nodes, shape).groupBy("tree", "block")
    return groups.cogroup(above.groupBy("tree", "block")).applyInArrow(lambda table, up: _prove(shape, table, up), PROVEN)


def manifest(docs: DataFrame, tampered: Column | None = None, shape: Shape | None = None) -> DataFrame:
    """Per row of ``docs`` its leaf, the roots, the digest of its proof, and the root that its leaf folds to.

    Where ``tampered`` holds, the fold takes the leaf of a row whose n_chars is one more.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("lang").cast("string").alias("lang"), "n_chars", "text")
    true = leaf(docs)
    more = leaf(docs, n_chars=docs["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)"))
    other = F.when(tampered, more).otherwise(true) if tampered is not None else true
    return merkle_proofs(docs.select("lang", "doc_id", true.alias("leaf"), other.alias("other")), shape)
