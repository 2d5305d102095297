"""Exact top-k inner product search by MaxScore over shards of a posting index.

A vector is a document whose terms are its dimensions. Each shard keeps one posting column per term and
knows the largest and the smallest weight in it, so every query has an upper bound per term. Terms are
taken from the largest bound down until the bounds of the rest cannot reach a share of the k-th best score alone:
those are the essential terms and their postings are traversed. The others are only probed for vectors
that can still win, term by term while vectors remain competitive. Shards of a stripe are searched one after
the other with the threshold that the earlier ones leave; stripes are merged by a last ranking.
Nothing is approximate: bounds never exclude a vector that ties with the k-th score.

Stripes of shards and groups of query blocks meet as cogroups, both sides of a bounded size: nothing is
broadcast or sent to the driver, and a query travels once per stripe, not once per shard.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, nor
does a row without an id; a shorter vector counts as padded with zeros; of rows with one id the smallest
vector stands for all; ties go to the smaller id; no queries or no vectors give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 2048
BLOCK_QUERIES = 1024
#: Bytes of packed vectors that one side of a cogroup holds at most, if a component takes eight (most take two).
SIDE_BYTES = 32 << 20
#: Stripes that are searched in parallel, where there are as many shards. More are made if one would exceed ``SIDE_BYTES``.
STRIPES = 64
#: Terms are essential until the rest can add no more than this share of the threshold: a probe costs more than a traversal.
PROBED = 0.25
_PACKED = "n long, dims long, ids binary, weights binary"


def _packed(rows: DataFrame, group: str, groups: int) -> DataFrame:
    """(id, weights) rows as one row for each of ``groups`` hash groups, in arrays of the smallest type that fits."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        lists = table["weights"].combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        weights = np.zeros((len(ids), int(length.max())), np.int64)
        weights[np.repeat(np.arange(len(ids)), length), _places(length)] = lists.flatten().to_numpy()
        order = np.lexsort((*weights.T[::-1], ids))
        order = order[np.r_[True, np.diff(ids[order]) != 0]]
        small = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= weights.min() and weights.max() <= np.iinfo(t).max)
        row = {group: [key[0].as_py()], "n": [len(order)], "dims": [weights.shape[1]]}
        row |= {"ids": [ids[order].tobytes()], "weights": [weights[order].astype(small).tobytes()]}
        return pa.table(row, schema=pa.schema([(group, pa.int64()), ("n", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary())]))

    keyed = rows.withColumn(group, F.pmod(F.xxhash64("id"), F.lit(groups)))
    return keyed.groupBy(group).applyInArrow(pack, f"{group} long, {_PACKED}")


def _places(length: np.ndarray) -> np.ndarray:
    """0, 1, 2, … within each of consecutive runs of the given lengths."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of a row of :func:`_packed`, the weights by vector."""
    kind = f"i{len(row['weights']) // (row['n'] * row['dims'])}"
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], kind).reshape(row["n"], row["dims"])


def _heads(columns: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A first threshold of each query and whether there is one: the k-th best full score of the vectors that are strongest in ``terms``."""
    n, m = columns.shape[1], len(queries)
    by_weight, by_vector, width = np.argsort(columns, axis=1), np.ascontiguousarray(columns.T), min(4 * k, n)
    floor, known = np.zeros(m, columns.dtype), np.zeros(m, bool)
    step = max(1, (4 << 20) // (terms.shape[1] * width * len(columns)))
    for at in range(0, m, step):
        q, t = queries[at : at + step], terms[at : at + step]
        heads = np.where(np.take_along_axis(q, t, 1)[:, :, None] > 0, by_weight[t, n - width :], by_weight[t, :width])
        heads = np.sort(heads.reshape(len(q), -1), axis=1)
        counts = ids[heads] != own[at : at + step, None]
        counts[:, 1:] &= heads[:, 1:] != heads[:, :-1]
        score = np.matmul(by_vector[heads], q[:, :, None])[:, :, 0]
        has = counts.sum(1) >= k
        # What does not count is behind everything that does.
        placed = np.take_along_axis(score, np.lexsort((-score, ~counts)), 1)
        known[at : at + step] = has
        if has.any():
            floor[at : at + step][has] = placed[has, k - 1]
    return floor, known


class Best:
    """The k best (score, id) of each query of a block so far, and the thresholds that they set."""

    def __init__(self, own: np.ndarray, k: int) -> None:
        self.own, self.k = own, k
        self.query, self.ids, self.scores = np.zeros((3, 0), np.int64)
        self.floor, self.last = np.zeros((2, len(own)), np.int64)
        self.known = np.zeros(len(own), bool)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Vectors that reach the thresholds; one that ties with the k-th score must have a smaller id to come in."""
        comes = ~self.known[query] | (scores > self.floor[query]) | (ids < self.last[query])
        query, ids, scores = (x[comes] for x in (query, ids, scores))
        query, ids, scores = np.r_[self.query, query], np.r_[self.ids, ids], np.r_[self.scores, scores]
        order = np.lexsort((ids, -scores, query))
        rank = _places(np.bincount(query, minlength=len(self.own)))
        order = order[rank < self.k]
        self.query, self.ids, self.scores = query[order], ids[order], scores[order]
        last = rank[rank < self.k] == self.k - 1
        full = self.query[last]
        self.floor[full], self.last[full], self.known[full] = self.scores[last], self.ids[last], True


def maxscore(columns: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Search one shard for a block of queries; ``columns`` are the postings by term, both hold integers."""
    dims = min(len(columns), queries.shape[1])
    columns, queries = columns[:dims], queries[:, :dims]
    low, high = columns.min(1), columns.max(1)
    most = (np.abs(queries.astype(float)) @ np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float)))).max()
    # Sums of integers are exact in floating point below the bounds; they are what BLAS multiplies.
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    columns, queries, low, high = (np.ascontiguousarray(x, kind) for x in (columns, queries, low, high))
    bound = np.maximum(np.maximum(queries * low, queries * high), 0)
    terms = np.argsort(-bound, axis=1, kind="stable")
    rest = np.zeros((len(queries), dims + 1), kind)
    rest[:, :-1] = np.cumsum(np.take_along_axis(bound, terms, 1)[:, ::-1], axis=1)[:, ::-1]
    floor, known = best.floor.astype(kind), best.known.copy()
    if not known.all():
        new = np.flatnonzero(~known)
        floor[new], known[new] = _heads(columns, ids, queries[new], best.own[new], terms[new, :4], best.k)
    share = np.where(floor > 0, PROBED * floor, floor)
    essential = np.where(known, np.minimum((rest > share[:, None]).sum(1), dims), dims)
    traversed = np.zeros(queries.shape, bool)
    np.put_along_axis(traversed, terms, np.arange(dims) < essential[:, None], 1)
    used = np.flatnonzero(traversed.any(0))
    partial = np.where(traversed, queries, 0)[:, used] @ columns[used]
    need = floor - np.take_along_axis(rest, essential[:, None], 1)[:, 0]
    need[~known] = np.iinfo(kind).min if kind is np.int64 else -np.inf
    query, left = np.nonzero(partial >= need[:, None])
    alive = ids[left] != best.own[query]
    query, left = query[alive], left[alive]
    partial, at = partial[query, left], essential[query]
    whole = []
    while len(at):
        if (done := at == dims).any():
            whole.append((query[done], ids[left[done]], partial[done].astype(np.int64)))
            query, left, partial, at = (x[~done] for x in (query, left, partial, at))
        term = terms[query, np.minimum(at, dims - 1)]
        partial = partial + queries[query, term] * columns[term, left]
        at = at + 1
        stay = partial + rest[query, at] >= floor[query]
        query, left, partial, at = (x[stay] for x in (query, left, partial, at))
    if whole:
        best.add(*map(np.concatenate, zip(*whole)))


def _search(k: int):
    def search(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = [_unpacked(row) for row in blocks.to_pylist()]
        found = [Best(own, k) for own, _ in asked]
        for at in range(shards.num_rows):
            ids, weights = _unpacked(shards.slice(at, 1).to_pylist()[0])
            columns = np.ascontiguousarray(weights.T)
            for best, (_, queries) in zip(found, asked):
                maxscore(columns, ids, queries, best)
        columns = [[best.own[best.query] for best in found], [best.ids for best in found], [best.scores for best in found]]
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in zip(("query_id", "vec_id", "score"), columns)})

    return search


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite components."""
    big = float("inf")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(big))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``is_query``, its k best other rows.

    Components become floor(scale * x). Queries travel in blocks: every block meets every stripe of shards once,
    with at most ``SIDE_BYTES`` of vectors on either side, and what moves is the packed blocks, not pairs of rows.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("weights"),
        is_query.alias("is_query"),
        F.size(vector).alias("dims"),
    )
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_query").alias("queries"), F.max("dims").alias("dims")).first()
    n_shards, n_blocks = max(1, -(-n["rows"] // shard_rows)), max(1, -(-n["queries"] // block_queries))
    # The k results of a query are held beside its vector.
    of_shards = max(1, SIDE_BYTES // (8 * (n["dims"] or 1) * shard_rows))
    of_blocks = max(1, SIDE_BYTES // (8 * max(n["dims"] or 1, 2 * k) * block_queries))
    n_stripes, n_groups = max(min(n_shards, STRIPES), -(-n_shards // of_shards)), -(-n_blocks // of_blocks)
    # Meetings are small in bytes and long in time: AQE must not merge them, and of more partitions few get two by their hash.
    met, tasks = ["stripe", "group"], min(4 * n_stripes * n_groups, 4000)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    shards = _packed(rows.select("id", "weights"), "shard", n_shards).withColumn("stripe", F.col("shard") % n_stripes).withColumn("group", every(n_groups))
    blocks = _packed(rows.where("is_query").select("id", "weights"), "block", n_blocks).withColumn("group", F.col("block") % n_groups).withColumn("stripe", every(n_stripes))
    sides = [side.select(*met, "n", "dims", "ids", "weights").repartition(tasks, *met).groupBy(*met) for side in (shards, blocks)]
    found = sides[0].cogroup(sides[1]).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
