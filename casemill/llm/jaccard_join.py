"""N-gram Jaccard join: exact components of documents whose word shingle sets are similar, by a grouped
prefix join.

1. Every text becomes its set of distinct shingles (fingerprints of ``width`` words). Documents with equal
   sets form a class; the class is known by its smallest id.
2. Shingles are dealt to buckets, equal (shingle, class) pairs of a task once. A bucket counts the classes
   of each shingle and gives back to every class the shingles that it shares, with their counts. Shingles
   of one class alone are never moved again: they count in the size only.
3. Prefix filter: with shingles ordered from rare to frequent, similar classes share one among the first
   n - ceil(t n) + 1. Shingles of one class come first, so a class with too many of them is out.
4. Classes with the same shared prefix and size collapse into one group. Groups that reach each other over
   prefix shingles are a family and are placed in one block, or in several bounded ones if they are many;
   blocks that share a prefix shingle form candidate pairs. A pair of blocks
   is expanded and verified in one task, all overlaps of a class with a block in one counting step, and
   a task gives each class with the smallest one it reaches; those rows of all tasks are contracted to about one
   per class, so a large set of near copies never becomes rows of pairs.
   First every block meets itself and the first block of each shingle; most near copies are connected then.
   Afterwards only classes whose shingles still lie in several components meet the blocks not met yet.
5. Components come from min-label rounds with shortcuts, on stored tables.

Nothing is sampled or capped; the component of every link is found. Fingerprints of shingles have 52 bits:
two different shingles of one pair of documents share one with a chance below 10**-9.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer than ``width``
words form one shingle; rows without an id get their size and no component (null) and link nothing;
repeated rows are equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from casemill.llm.words import mixed, text_chunks, word_fingerprints, word_lists
from casemill.session import durable, release

WIDTH = 5
THRESHOLD = (75, 100)
BLOCK_CLASSES = 128
#: Bytes of text whose shingles one bucket holds.
BUCKET_BYTES = 8 << 20
_BITS = 52
_ROW_LIMIT = 1 << (64 - _BITS)
_WEIGHTS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) pairs, distinct, in order of row and shingle. At most 4,096 texts."""
    words, ends = word_lists(pc.ascii_lower(texts))
    hashes = word_fingerprints(words)
    starts = np.r_[0, ends[:-1]]
    row_of = np.repeat(np.arange(len(ends)), ends - starts)
    sums = np.zeros(len(hashes), np.uint64)
    left = ends[row_of] - np.arange(len(hashes))
    for k in range(width):
        part = hashes[k:] * _WEIGHTS[k]
        inside = left[: len(part)] > k
        sums[: len(part)][inside] += part[inside]
    lengths = ends - starts
    first = np.zeros(len(hashes), bool)
    first[starts[lengths > 0]] = True
    whole = (left >= width) | (first & (lengths[row_of] < width))
    shingles = mixed(sums[whole]) >> np.uint64(64 - _BITS)
    keys = np.unique(row_of[whole].astype(np.uint64) << np.uint64(_BITS) | shingles)
    return (keys >> np.uint64(_BITS)).astype(np.int64), (keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for start, stop in text_chunks(texts):
        for at in range(start, stop, _ROW_LIMIT):
            yield at, min(stop, at + _ROW_LIMIT)


def _signatures(rows: np.ndarray, shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, signature, second signature) of each row's set."""
    sizes = np.bincount(rows, minlength=n)
    values = mixed(shingles.astype(np.uint64) + np.uint64(1))
    upto = np.r_[np.zeros(1, np.uint64), np.cumsum(values)]
    more = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(values))]
    ends = np.cumsum(sizes)
    of = lambda sums: mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).astype(np.int64)
    return sizes, of(upto), of(more)


def _measure(width: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _chunks(batch["text"]):
                found = _signatures(*shingle_sets(batch["text"].slice(start, stop - start), width), stop - start)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start), *(pa.array(x, pa.int64()) for x in found)],
                    names=["doc_id", "n", "sig", "sig2"],
                )

    return measure


def _deal(width: int, buckets: int):
    """(shingle, class) pairs of each chunk by bucket, compressed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _chunks(batch["text"]):
                rows, shingles = shingle_sets(batch["text"].slice(start, stop - start), width)
                _, sigs, _ = _signatures(rows, shingles, stop - start)
                # Equal sets of the chunk once: the class of a row is its first row.
                _, first, inverse = np.unique(sigs, return_index=True, return_inverse=True)
                kept = first[inverse] == np.arange(len(sigs))
                use = kept[rows]
                rows, shingles = rows[use], shingles[use]
                bucket = shingles % buckets
                order = np.lexsort((shingles, bucket))
                rows, shingles, bucket = rows[order].astype(np.uint16), shingles[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for b in range(buckets):
                    own = slice(cuts[b], cuts[b + 1])
                    if own.stop > own.start:
                        used, place = np.unique(rows[own], return_inverse=True)
                        deltas = np.diff(shingles[own], prepend=0)
                        out.append((
                            b, sigs[used].tobytes(), zlib.compress(place.astype(np.uint16).tobytes(), 1),
                            zlib.compress(deltas.view(np.uint8).reshape(-1, 8).T.tobytes(), 1),
                        ))
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                        names=["bucket", "sigs", "places", "shingles"],
                    )

    return deal


def _shared(groups: int):
    def shared(key: tuple, table: pa.Table) -> pa.Table:
        return _shared_of(table, groups)

    return shared


def _shared_of(table: pa.Table, groups: int) -> pa.Table:
    """Of one bucket the (class, shingle) pairs whose shingle other classes have too, by group of classes."""
    sigs, shingles = [], []
    for s, p, h in zip(table["sigs"].to_pylist(), table["places"].to_pylist(), table["shingles"].to_pylist()):
        sigs.append(np.frombuffer(s, np.int64)[np.frombuffer(zlib.decompress(p), np.uint16)])
        bytes_ = np.frombuffer(zlib.decompress(h), np.uint8).reshape(8, -1).T
        shingles.append(np.cumsum(np.ascontiguousarray(bytes_).view(np.int64).ravel()))
    sigs, shingles = np.concatenate(sigs), np.concatenate(shingles)
    order = np.argsort(shingles, kind="stable")
    sigs, shingles = sigs[order], shingles[order]
    # A shingle met once needs no further look.
    twin = np.r_[False, shingles[1:] == shingles[:-1]]
    often = twin | np.r_[twin[1:], False]
    sigs, shingles = sigs[often], shingles[often]
    order = np.lexsort((sigs, shingles))
    sigs, shingles = sigs[order], shingles[order]
    new = np.r_[True, (shingles[1:] != shingles[:-1]) | (sigs[1:] != sigs[:-1])][: len(sigs)]
    sigs, shingles = sigs[new], shingles[new]
    _, inverse, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    counts = counts[inverse]
    order = np.flatnonzero(counts > 1)
    order = order[np.argsort(sigs[order] % groups, kind="stable")]
    sigs, shingles, counts = sigs[order], shingles[order], counts[order].astype(np.int32)
    cuts = np.searchsorted(sigs % groups, np.arange(groups + 1))
    own = [g for g in range(groups) if cuts[g + 1] > cuts[g]]
    part = lambda values: pa.array([values[cuts[g] : cuts[g + 1]].tobytes() for g in own], pa.binary())
    return pa.table({"g": pa.array(own, pa.int64()), "sigs": part(sigs), "shingles": part(shingles), "counts": part(counts)})


def _prefixes(threshold: tuple[int, int]):
    """Classes of one group of rows with all their shared shingles (sorted) and the shared part of their prefix."""
    part, whole = threshold

    def prefixes(key: tuple, table: pa.Table, classes: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table[c])])
        sigs, shingles, counts = read("sigs", np.int64), read("shingles", np.int64), read("counts", np.int32)
        known, sizes = classes["sig"].to_numpy(), classes["n"].to_numpy()
        reps = classes["rep"].to_numpy()
        order = np.argsort(known, kind="stable")
        known, sizes, reps = known[order], sizes[order], reps[order]
        held = np.bincount(np.searchsorted(known, sigs), minlength=len(known))
        # Shingles of the class alone come first in the prefix; what is left of it are shared ones.
        need = held - -(-part * sizes // whole) + 1
        use = (need > 0)[np.searchsorted(known, sigs)]
        sigs, shingles, counts = sigs[use], shingles[use], counts[use]
        order = np.lexsort((shingles, counts, sigs))
        sigs, shingles = sigs[order], shingles[order]
        cuts = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sigs)]):
            at = int(np.searchsorted(known, sigs[a]))
            prefix = np.sort(shingles[a : a + need[at]])
            out.append((int(reps[at]), int(sizes[at]), np.sort(shingles[a:b]).tobytes(), prefix.tolist()))
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [("rep", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64()))]
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)})

    return prefixes


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """A block of classes in arrays."""
    shingles = table["shingles"].to_pylist()
    sizes = np.array([len(s) // 8 for s in shingles], np.int64)
    order = np.argsort(table["rep"].to_numpy(), kind="stable")
    row = {
        "block": [key[0].as_py()], "reps": [table["rep"].to_numpy()[order].tobytes()], "ns": [table["n"].to_numpy()[order].tobytes()],
        "sizes": [sizes[order].tobytes()], "shingles": [b"".join(shingles[i] for i in order)],
    }
    return pa.table(row, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("reps", "ns", "sizes", "shingles"))]))


def _verify(threshold: tuple[int, int]):
    """Linked classes of a task's pairs of blocks as rows (a, b): every class with the smallest one that it reaches."""
    part, whole = threshold

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for at_row in range(batch.num_rows):
                # One pair of blocks in memory at a time.
                read = lambda c, batch=batch, i=at_row: np.frombuffer(batch[c][i].as_buffer(), np.int64)
                reps, ns, sizes, shingles = (read(f"b_{c}") for c in ("reps", "ns", "sizes", "shingles"))
                owner = np.repeat(np.arange(len(reps)), sizes)
                order = np.argsort(shingles, kind="stable")
                shingles, owner = shingles[order], owner[order]
                own_reps, own_ns, ends = read("a_reps"), read("a_ns"), np.cumsum(read("a_sizes"))
                own = read("a_shingles")
                others = {root(x) for x in reps.tolist()}
                for i, rep in enumerate(own_reps.tolist()):
                    others = {root(x) for x in others}
                    if others == {root(rep)}:
                        # All of the block is connected with this class: more links change nothing.
                        continue
                    mine = own[ends[i - 1] if i else 0 : ends[i]]
                    low, high = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
                    hit = high > low
                    low, count = low[hit], (high - low)[hit]
                    at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
                    both = np.bincount(owner[at], minlength=len(reps))
                    for j in np.flatnonzero(whole * both >= part * (ns + own_ns[i] - both)).tolist():
                        a, b = root(rep), root(int(reps[j]))
                        if a != b:
                            parent[max(a, b)] = min(a, b)
        pairs = np.array([(root(x), x) for x in list(parent) if root(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pairs[:, 0], pairs[:, 1]], names=["a", "b"])

    return verify


def contracted(stars: DataFrame) -> DataFrame:
    """(a, b) with the same components as the ``stars`` (a, b) of all tasks: one row per class ``b``, with its
    least centre, and one per pair of centres that a class joins, however many tasks have found it."""
    least = stars.groupBy("b").agg(F.min("a").alias("least"))
    centres = stars.join(least, "b").where(F.col("a") != F.col("least")).select(F.col("least").alias("x"), F.col("a").alias("y")).distinct()
    return least.select(F.col("least").alias("a"), "b").union(centres)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over ``links`` (a, b), for every id in a link."""
    both = durable(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    stored = labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("low"))
        # The label of the label: paths halve in every round.
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        after = durable(
            lower.join(jump, "low", "left").select("id", "label", F.least("low", F.coalesce("far", "low")).alias("next"))
        )
        changed = after.where("label <> next").limit(1).count()
        release(stored)
        stored, labels = after, after.select("id", F.col("next").alias("label"))
        if not changed:
            release(both)
            return labels


def _families(postings: DataFrame) -> DataFrame:
    """(grp, near, family): the smallest group that shares a shingle with one sharing a shingle with it, and
    the smallest group reachable over shared shingles at all."""

    def closer(key: DataFrame) -> DataFrame:
        least = postings.join(key, "grp").groupBy("shingle").agg(F.min("key").alias("key"))
        return postings.join(least, "shingle").groupBy("grp").agg(F.min("key").alias("key"))

    key = durable(closer(postings.select("grp", F.col("grp").alias("key")).distinct()))
    near = key
    while True:
        far = key.select(F.col("grp").alias("key"), F.col("key").alias("far"))
        after = closer(key).join(far, "key", "left").select("grp", F.least("key", F.coalesce("far", "key")).alias("key"))
        after = durable(after)
        changed = after.join(key.withColumnRenamed("key", "old"), "grp").where("key < old").limit(1).count()
        if key is not near:
            release(key)
        key = after
        if not changed:
            return near.select("grp", F.col("key").alias("near")).join(key.withColumnRenamed("key", "family"), "grp")


def _blocks(classes: DataFrame, size: int, n: int) -> DataFrame:
    """(block, …): classes of one ``family`` together, in blocks of about ``size``.

    A larger family is split between its near groups, and one of these by class if it alone is too large.
    """
    members = classes.groupBy("family").agg(F.count(F.lit(1)).alias("_m"))
    inner = classes.groupBy("near").agg(F.count(F.lit(1)).alias("_k")).withColumnRenamed("near", "_near")
    parts, slices = F.ceil(F.col("_m") / size), F.ceil(F.col("_k") / size)
    by_class = F.xxhash64(F.lit("class"), "near", F.pmod(F.xxhash64("rep"), slices))
    by_near = F.xxhash64(F.lit("near"), "family", F.pmod(F.xxhash64("near"), parts))
    together = F.pmod(F.xxhash64("family"), F.lit(max(1, n // size)))
    block = F.when(slices > 1, by_class).when(parts > 1, by_near).otherwise(together)
    joined = classes.join(members, "family").join(inner, F.col("near") == F.col("_near"))
    return joined.withColumn("block", block).drop("_m", "_k", "_near")


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Verified links of (a_block, b_block) ``pairs`` of packed blocks."""
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    joined = pairs.join(named(left, "a"), "a_block").join(named(right, "b"), "b_block")
    return joined.mapInArrow(_verify(threshold), "a long, b long")


def joined(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD,
    block_classes: int = BLOCK_CLASSES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Two documents link if ``threshold[1] * |both| >= threshold[0] * |either|``; ``component_id`` is the
    smallest id reachable by links.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = durable(texts.mapInArrow(_measure(width), "doc_id long, n long, sig long, sig2 long"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    classes = durable(
        rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep"))
    )
    groups = buckets
    shared = (
        texts.where(F.col("doc_id").isNotNull())
        .mapInArrow(_deal(width, buckets), "bucket long, sigs binary, places binary, shingles binary")
        .groupBy("bucket").applyInArrow(_shared(groups), "g long, sigs binary, shingles binary, counts binary")
    )
    live = durable(
        shared.groupBy("g").cogroup(classes.withColumn("g", F.pmod("sig", F.lit(groups))).groupBy("g"))
        .applyInArrow(_prefixes(threshold), "rep long, n long, shingles binary, prefix array<long>")
        # Equal prefix and size: one group, known by its smallest class.
        .withColumn("prefix_id", F.xxhash64("prefix", "n"))
    )
    group_ids = live.groupBy("prefix_id", "n").agg(F.min("rep").alias("grp"), F.first("prefix").alias("prefix"))
    postings = durable(group_ids.select("grp", F.explode("prefix").alias("shingle")))
    key = durable(_families(postings))
    of_group = live.select("rep", "n", "prefix_id").join(
        group_ids.select("prefix_id", F.col("n").alias("_n"), "grp"), (F.col("_n") == F.col("n")) & (live["prefix_id"] == group_ids["prefix_id"])
    ).select("rep", "grp")
    n_live = live.count()
    placed = durable(_blocks(of_group.join(key, "grp"), block_classes, n_live))
    packed = "block long, reps binary, ns binary, sizes binary, shingles binary"
    sets = live.select("rep", "n", "shingles")
    # The sets themselves move once, to their block.
    blocks = durable(sets.join(placed.select("rep", "block"), "rep").groupBy("block").applyInArrow(_pack, packed))
    where = durable(placed.select("grp", "block").distinct().join(postings, "grp").select("shingle", "block").distinct())
    hubs = where.groupBy("shingle").agg(F.min("block").alias("a_block"))
    stars = where.join(hubs, "shingle").select("a_block", F.col("block").alias("b_block"))
    inside = where.select(F.col("block").alias("a_block"), F.col("block").alias("b_block"))
    first = durable(stars.union(inside).distinct())
    links = durable(contracted(durable(_meet(blocks, blocks, first, threshold))))
    labels = components(links)
    label_of = placed.select("rep", "grp", "block").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    label_of = durable(label_of)
    # Shingles whose classes are still in several components, and the classes outside the largest of them.
    sizes = postings.join(label_of, "grp").groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_shingles = durable(main.select("shingle", F.col("main.label").alias("main")))
    outside = (
        postings.join(open_shingles, "shingle").join(label_of, "grp").where(F.col("label") != F.col("main")).select("rep", "shingle")
    )
    outside = durable(outside.distinct())
    # A class outside meets the blocks that its own has not met yet.
    seekers = durable(outside.select("rep").distinct().join(placed.select("rep", "block"), "rep"))
    asked = outside.join(seekers, "rep").select("shingle", F.col("block").alias("a_block")).distinct()
    met = first.union(first.select(F.col("b_block").alias("a_block"), F.col("a_block").alias("b_block"))).distinct()
    rest = asked.join(where.withColumnRenamed("block", "b_block"), "shingle").select("a_block", "b_block").distinct()
    rest = durable(rest.join(met, ["a_block", "b_block"], "left_anti"))
    asking = sets.join(seekers, "rep").groupBy("block").applyInArrow(_pack, packed)
    more = contracted(durable(_meet(asking, blocks, rest, threshold)))
    final = components(links.union(more))
    release(live, blocks, postings, placed, where, label_of, outside, seekers, rest, links)
    by_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "sig", "sig2", F.col("n").alias("_n"), F.coalesce("label", "rep").alias("component")
    )
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return (
        rows.join(by_class.withColumnRenamed("sig", "_a").withColumnRenamed("sig2", "_b"),
                  (F.col("sig") == F.col("_a")) & (F.col("sig2") == F.col("_b")) & (F.col("n") == F.col("_n")), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    )
