"""Merkle manifest of a dataset: a hash tree per group, and one over the groups, with midstates for folding.

Every row is a leaf: the SHA-256 of its fields, each written with its length (``leaf``). The leaves of a group
stand in order; every ``arity`` consecutive nodes become the hash of their hexadecimal digests, until one is
left. The subroots of the groups, in order, become the root in the same way.

1. Leaves are hashed by Spark's own functions, stored, sorted by ranges and numbered inside their group, from the
   sizes of the ranges.
2. ``arity ** height`` consecutive leaves are a block, a whole subtree: one task step turns it into one node, and
   the nodes of all blocks are the next level. A group of any size is spread over its blocks.
3. The way down gives every node its siblings, level by level, and a block those of its ancestors once.
4. A parent keeps a copy of the hash state before each child's slot. To fold a leaf up the tree, the state
   before its slot is copied and resumed with the replacement and the siblings to the right alone; those
   to the left are never hashed again. The states of a block's ancestors are made once per block.

Only the number of nodes of the largest group comes to the driver. Work and memory of a task are bounded by the
block.

Defined results: null fields are ``-``; a null group comes first and is a group of its own; rows of a group with
null order columns come first; rows that repeat their order columns follow by leaf, equal rows in any order
(their nodes are equal); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from casemill.session import durable

ARITY = 2
HEIGHT = 11
_NODE = "g string, i long, n long, node string"
_CHAIN = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: of every field ``-`` if null, else its length in bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Slot:
    """A child's place in its parent: the state that has read the siblings to the left, and those to the right."""

    __slots__ = ("left", "right", "state")

    def __init__(self, state, left: bytes, right: bytes) -> None:
        self.state, self.left, self.right = state, left, right

    def folded(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child)
        state.update(self.right)
        return state.hexdigest().encode()


def parent_of(children: Sequence[bytes]) -> tuple[bytes, list[Slot]]:
    """(digest of a run of siblings, the slot of each with a copy of the state before it)."""
    state, slots, whole = hashlib.sha256(), [], b"".join(children)
    for at, child in enumerate(children):
        slots.append(Slot(state.copy(), whole[: at * 64], whole[(at + 1) * 64 :]))
        state.update(child)
    return state.hexdigest().encode(), slots


def levels_of(n: int, arity: int, most: int) -> int:
    """Levels of parents over ``n`` nodes, at most ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // arity), levels + 1
    return levels


def subtree(nodes: Sequence[bytes], arity: int, levels: int) -> tuple[bytes, list[list[Slot]]]:
    """(the one node left, the slots of every level from the leaves up)."""
    every = []
    for _ in range(levels):
        slots, parents = [], []
        for start in range(0, len(nodes), arity):
            digest, own = parent_of(nodes[start : start + arity])
            parents.append(digest)
            slots += own
        every.append(slots)
        nodes = parents
    return nodes[0], every


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["i"].to_numpy(), kind="stable")))


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [x.encode() for x in column.to_pylist()]


def _raised(arity: int, height: int):
    def raised(key: tuple, table: pa.Table) -> pa.Table:
        table = _in_order(table)
        n = table["n"][0].as_py()
        node, _ = subtree(_texts(table["node"]), arity, levels_of(n, arity, height))
        row = {"g": [key[0].as_py()], "i": [key[1].as_py()], "n": [-(-n // arity**height)], "node": [node.decode()]}
        return pa.table(row, schema=pa.schema([("g", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    return raised


def _lowered(arity: int, height: int):
    """Every node of a block with its siblings up to the root, from those of the block."""

    def lowered(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)
        n, count = table["n"][0].as_py(), table.num_rows
        _, every = subtree(_texts(table["node"]), arity, levels_of(n, arity, height))
        upper = above["chain"][0].as_py()
        chains = []
        for at in range(count):
            own = [slots[at // arity**k] for k, slots in enumerate(every)]
            chains.append([{"left": s.left.decode(), "right": s.right.decode()} for s in own] + upper)
        out = {"g": table["g"], "i": table["i"], "chain": pa.array(chains, _PATH), "name": table["name"]}
        for c in ("subroot", "root"):
            out[c] = pa.array([above[c][0].as_py()] * count, pa.string())
        return pa.table(out)

    return lowered


def _checked(arity: int, height: int, names: list[str]):
    """Leaves of a block with their proof and what folding them gives."""

    def checked(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)
        n = table["n"][0].as_py()
        _, every = subtree(_texts(table["node"]), arity, levels_of(n, arity, height))
        upper = []
        for s in above["chain"][0].as_py():
            left = s["left"].encode()
            upper.append(Slot(hashlib.sha256(left), left, s["right"].encode()))
        tail = b"".join(s.left + s.right for s in upper)
        proofs, roots = [], []
        for at, value in enumerate(_texts(table["seen"])):
            proof = hashlib.sha256()
            for k, slots in enumerate(every):
                slot = slots[at // arity**k]
                proof.update(slot.left)
                proof.update(slot.right)
                value = slot.folded(value)
            proof.update(tail)
            for slot in upper:
                value = slot.folded(value)
            proofs.append(proof.hexdigest())
            roots.append(value.decode())
        count, root = table.num_rows, above["root"][0].as_py()
        whole = {
            **{c: table[c] for c in names}, "leaf": table["node"], "subroot": pa.array([above["subroot"][0].as_py()] * count, pa.string()),
            "root": pa.array([root] * count, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(roots, pa.string()), "verified": pa.array([r == root for r in roots], pa.bool_()),
        }
        return pa.table(whole)

    return checked


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` stored with ``i``, their number in their group ``g`` from 0, and ``n``, the size of the group."""
    placed = durable(rows.orderBy("g", *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy("g", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy("g")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("g").alias("_g"), "_part", (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_m").over(group).alias("n"),
    )
    joined = placed.withColumn("_p", F.shiftright("_at", 33)).join(starts, (F.col("g") == F.col("_g")) & (F.col("_p") == F.col("_part")))
    return joined.withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_g", "_p", "_part")


def _block(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"i div {arity**height}"))


def _levels(leaves: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Stored nodes from ``leaves`` to one node per group, ``height`` levels of the tree at a time."""
    levels, n = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while n > 1:
        nodes = _block(levels[-1].select("g", "i", "n", "node"), arity, height)
        levels.append(durable(nodes.groupBy("g", "block").applyInArrow(_raised(arity, height), _NODE)))
        n = -(-n // arity**height)
    return levels


def _chains(levels: list[DataFrame], above: DataFrame, arity: int, height: int) -> DataFrame:
    """(g, i, chain, name, subroot, root) of the nodes of ``levels[0]``."""
    schema = f"g string, i long, chain {_CHAIN}, name string, subroot string, root string"
    for nodes in reversed(levels):
        nodes = nodes if "name" in nodes.columns else nodes.withColumn("name", F.lit(None).cast("string"))
        blocks = _block(nodes.select("g", "i", "n", "node", "name"), arity, height).groupBy("g", "block")
        above = durable(blocks.cogroup(above.groupBy("g", "i")).applyInArrow(_lowered(arity, height), schema))
    return above


def manifest(
    rows: DataFrame, fields: Sequence[str], group: str, order: Sequence[str], changes: Mapping[str, Column] | None = None,
    arity: int = ARITY, height: int = HEIGHT,
) -> DataFrame:
    """(*order, group, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``rows``.

    Leaves hash ``fields`` of the rows as they are. ``changes`` gives some fields as they are found now (a change
    to null is none): ``folded_root`` is the root that a row's leaf as found, with the siblings of the manifest,
    leads to, and ``verified`` tells whether that is the manifest's root. ``proof_sha256`` is the hash of all
    siblings from the leaf up, left to right.
    """
    names = list(dict.fromkeys([*order, group]))
    own = [F.col(f) for f in fields]
    found = [F.coalesce((changes or {}).get(f, F.col(f)), F.col(f)) for f in fields]
    name = F.col(group).cast("string")
    # Null first, then by bytes; never null itself.
    of_group = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    hidden = {c: f"c{at}" for at, c in enumerate(names)}
    leaves = durable(rows.select(
        of_group.alias("g"), *[F.col(c).alias(h) for c, h in hidden.items()], leaf(own).alias("node"),
        (leaf(found) if changes else leaf(own)).alias("seen"), F.monotonically_increasing_id().alias("_row"),
    ))
    placed = durable(numbered(leaves, [*[hidden[c] for c in order], "node", "_row"]).drop("_row"))
    levels = _levels(placed, arity, height)
    subroots = durable(levels[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "node"))
    tops = _levels(durable(numbered(subroots, ["name"])), arity, height)
    none = F.array().cast(_CHAIN)
    start = tops[-1].select("g", "i", none.alias("chain"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    top = _chains(tops[:-1], start, arity, height) if len(tops) > 1 else start.crossJoin(subroots.select("name"))
    above = top.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("i"), "chain", "root")
    above = above.join(levels[-1].select("g", F.col("node").alias("subroot")), "g")
    if len(levels) > 2:
        above = _chains(levels[1:-1], above, arity, height)
    schema = StructType([
        *[StructField(h, rows.schema[c].dataType) for c, h in hidden.items()],
        *StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"),
    ])
    blocks = _block(placed, arity, height).groupBy("g", "block")
    checked = blocks.cogroup(above.groupBy("g", "i")).applyInArrow(_checked(arity, height, list(hidden.values())), schema)
    return checked.withColumnsRenamed({h: c for c, h in hidden.items()})
