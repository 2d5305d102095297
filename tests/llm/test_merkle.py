"""The manifest against a plain tree over all rows, for several shapes of blocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casemill.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, i long, node string, n int, seen int, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def levels(nodes, arity):
    every = [nodes]
    while len(every[-1]) > 1:
        every.append([sha(*every[-1][a : a + arity]) for a in range(0, len(every[-1]), arity)])
    return every


def siblings(every, at, arity):
    """(left, right) lists from the leaf up."""
    found = []
    for level in every[:-1]:
        start = at // arity * arity
        found.append((level[start:at], level[at + 1 : start + arity]))
        at //= arity
    return found


def plain(rows, arity, found):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], arity)
    top = levels([trees[g][-1][0] for g in order], arity)
    out = []
    for j, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            path = siblings(trees[g], at, arity) + siblings(top, j, arity)
            value = leaf(found(r))
            for left, right in path:
                value = sha(*left, value, *right)
            proof = sha(*[x for left, right in path for x in left + right])
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    langs = [None, "", "en", "en", "en", "é", "z"]
    rows = [
        {"doc_id": i, "text": f"text {i}", "lang": langs[i % 7], "source": None if i % 5 == 0 else f"s{i}", "n_chars": None if i % 11 == 0 else i}
        for i in range(n)
    ]
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[3], text="other"), dict(rows[4], doc_id=None), dict(rows[2], text=None), dict(rows[2], text="ü" * 300_000)]
    return rows


@pytest.mark.parametrize("arity, height", [(2, 2), (3, 1), (2, 11)])
def test_equals_a_plain_tree(spark, arity, height):
    rows = rows_of(90)
    df = spark.createDataFrame([(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "g", 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    changes = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(df, FIELDS, "lang", ["doc_id"], changes, arity, height)
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def found(r):
        touched = r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["n_chars"] is not None
        return dict(r, n_chars=r["n_chars"] + 1) if touched else r

    assert sorted((tuple(r) for r in got.drop("lang").collect()), key=repr) == plain(rows, arity, found)


def test_one_row_and_no_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (row,) = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], schema), FIELDS, "lang", ["doc_id"]).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha()
    assert merkle.manifest(spark.createDataFrame([], schema), FIELDS, "lang", ["doc_id"]).count() == 0


def test_folding_reads_the_state_before_the_slot():
    children = [sha(str(i)).encode() for i in range(5)]
    digest, slots = merkle.parent_of(children)
    assert digest.decode() == sha(*[c.decode() for c in children])
    for at, slot in enumerate(slots):
        other = sha("new").encode()
        assert slot.folded(children[at]) == digest
        assert slot.folded(other).decode() == sha(*[(other if k == at else c).decode() for k, c in enumerate(children)])
