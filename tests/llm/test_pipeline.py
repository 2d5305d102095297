"""The pipeline stage by stage on a small corpus, against what brute force keeps."""


import corpus_pipeline
from test_jaccard_join import brute as components
from test_suffix_dedup import brute as removed

from casemill.session import durable

LINES = "the house of number {i} and the garden of word{i} with a tree{i} was on the hill{i} for the people{i} of town{i}"


def clean(start, n=8):
    return "\n".join(LINES.format(i=start * 100 + i) for i in range(n))


def corpus(spark):
    rows = [(i, clean(i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, clean(i) + " the end", "en", "s1", 0) for i in range(5)]
    rows += [(200, "too short", "en", "s2", 0), (201, None, "en", None, 0), (202, "spam " * 100, "en", "s2", 0)]
    rows += [(300, clean(70) + "\n" + clean(3, 4), "en", None, 0), (None, clean(80), "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = corpus(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, ""))
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
    ids = lambda name: {r.doc_id for r in kept[name].collect()}
    assert ids("quality_rules") == {*range(40), *range(100, 105), 300, None}
    good = [(r.doc_id, r.text) for r in kept["quality_rules"].collect() if r.doc_id is not None]
    assert ids("jaccard_join") == {i for i, _, c in components(good) if i == c} | {None}
    left = {r.doc_id: r.text for r in kept["jaccard_join"].collect()}
    expected = removed([(i, t) for i, t in left.items() if i is not None], 100)
    for r in kept["suffix_dedup"].collect():
        assert r.n_chars == len(r.text)
        assert r.doc_id is None or len(left[r.doc_id].encode()) - len(r.text.encode()) == expected[r.doc_id][1]
    size = lambda df: sum(len(r.text.split()) for r in df.collect())
    total = size(kept["suffix_dedup"])
    assert total * 1.5 - 200 <= size(kept["mix_sources"]) <= total * 1.5
    packed = kept["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == ids("mix_sources")
    assert packed.where("piece = 0").count() == kept["mix_sources"].count()


def test_run_is_the_stages(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_corpus(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_are_mixed_one_by_one(spark):
    rows = [(None, clean(i, 2), "en", f"s{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, corpus(spark).schema)
    total = sum(len(r[1].split()) for r in rows)
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert total * 1.5 - 60 <= sum(len(r.text.split()) for r in mixed) <= total * 1.5
    assert len({mixed.count(r) for r in mixed}) == 2


def test_only_the_near_copy_of_a_repeated_id_goes(spark):
    rows = [(1, clean(1) + " the end", "en", "s", 0), (2, clean(1), "en", "s", 0), (2, clean(2), "en", "s", 0)]
    rows += [(3, clean(3), "en", "s", 0)] * 2 + [(None, clean(2), "en", "s", 0), (None, clean(4), "en", "s", 0)]
    docs = spark.createDataFrame(rows, corpus(spark).schema)
    found = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 9, r.text) for r in found) == [
        (1, rows[0][1]), (2, clean(2)), (3, clean(3)), (9, clean(4)),
    ]


def test_row_numbers_follow_the_ids(spark):
    rows = [(i % 7 or None, clean(i, 1), "en", "s", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, corpus(spark).schema).repartition(5)
    numbered = sorted((r.row, r.doc.doc_id or 9, r.doc.text) for r in corpus_pipeline.with_rows(docs).collect())
    assert [n for n, _, _ in numbered] == list(range(50))
    assert [r[1:] for r in numbered] == sorted((i or 9, t) for i, t, *_ in rows)


def test_other_columns_may_have_any_name_and_n_chars_may_lack(spark):
    more = ["_row", "_copy", "_copies", "kept_text", "copies", "row", "doc", "_at", "_part", "count", "part"]
    rows = [(i % 30, clean(i % 25, 6), f"s{i % 3}", *[f"{c}{i % 30}" for c in more]) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in more]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "source", *more]
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in more)
    assert docs.count() > 0
