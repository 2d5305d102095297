"""Digests of files larger than a row may be."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from casemill.plans import ingest
from casemill.sources import digests, readers
from casemill.workload.tables import cases


def written(folder, **sizes):
    files = {}
    for name, size in sizes.items():
        data = bytes((i * i * 31 + len(name) + i // 7) % 251 for i in range(size))
        with open(f"{folder}/{name}.bin", "wb") as file:
            file.write(data)
        files[f"{name}.bin"] = data
    return files


def tree(data, range_bytes, fanout):
    """The same tree built level by level on one machine."""
    cuts = range(0, max(len(data), 1), range_bytes)
    level = [hashlib.sha256(b"\x00" + data[i : i + range_bytes]).hexdigest() for i in cuts]
    while len(level) > 1:
        groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        level = [g[0] if len(g) == 1 else hashlib.sha256(b"\x01" + "".join(g).encode()).hexdigest() for g in groups]
    return level[0]


def test_large_files_are_streamed(spark, tmp_path):
    files = written(tmp_path, small=10, edge=1000, over=1001, big=300_001)
    written(tmp_path, empty=0)  # Spark lists no empty files
    found = readers.source_files(spark, str(tmp_path), row_bytes=1000)
    assert {r.file_name: (r.bytes, r.sha256) for r in found.collect()} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()
    }
    small_reads = {r.path: r.sha256 for r in digests.stream_digests(
        digests.list_files(spark, str(tmp_path)), read_bytes=7_001).collect()}
    assert sorted(small_reads.values()) == sorted(hashlib.sha256(d).hexdigest() for d in files.values())


def test_larger_than_spark_allows_for_a_row(spark, tmp_path):
    files = written(tmp_path, big=50_000, small=5)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = {r.file_name: r.sha256 for r in readers.source_files(spark, str(tmp_path), row_bytes=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}


@pytest.mark.parametrize("range_bytes, fanout", [(64, 2), (100, 3), (1000, 1024), (10_000, 2)])
def test_tree_equals_brute_force(spark, tmp_path, range_bytes, fanout):
    files = written(tmp_path, empty=0, one=1, exact=200, odd=6_401, big=10_000)
    rows = [(f"file:{tmp_path}/{n}", len(d)) for n, d in files.items()]
    listed = spark.createDataFrame(rows, "path string, length long")
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in digests.tree_digests(listed, range_bytes, fanout).collect()}
    assert found == {n: tree(d, range_bytes, fanout) for n, d in files.items()}


def test_ranges_cover_a_file_and_are_spread(spark, tmp_path):
    (data,) = written(tmp_path, big=10_001).values()
    ranges = digests.range_digests(digests.list_files(spark, str(tmp_path)), 256)
    rows = ranges.withColumn("task", F.spark_partition_id()).orderBy("range_no").collect()
    assert [r.start for r in rows] == list(range(0, len(data), 256)) and sum(r.bytes for r in rows) == len(data)
    assert len({r.task for r in rows}) > 1
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_a_changed_byte_changes_the_tree(spark, tmp_path):
    written(tmp_path, big=5_000)
    before = readers.source_files(spark, str(tmp_path), by="tree", range_bytes=512).first().sha256
    with open(tmp_path / "big.bin", "r+b") as file:
        file.seek(4_999)
        file.write(b"\xff")
    assert readers.source_files(spark, str(tmp_path), by="tree", range_bytes=512).first().sha256 != before
    with pytest.raises(ValueError):
        readers.source_files(spark, str(tmp_path), by="name")
    with pytest.raises(ValueError):
        digests.tree_digests(digests.list_files(spark, str(tmp_path)), fanout=1)


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for by in ("content", "tree", "listing"):
        assert readers.source_files(spark, str(tmp_path / "none"), by=by).count() == 0


def test_names_and_openers(spark, tmp_path):
    odd = tmp_path / "a b%20ü"
    odd.mkdir()
    files = written(odd, x=3_000)
    found = readers.source_files(spark, str(odd), row_bytes=10).collect()
    assert [r.sha256 for r in found] == [hashlib.sha256(d).hexdigest() for d in files.values()]

    def other_store(path):
        return digests.open_file(path.replace("file:", ""))

    again = readers.source_files(spark, str(odd), by="tree", range_bytes=100, opener=other_store).first()
    assert again.sha256 == tree(files["x.bin"], 100, digests.FANOUT)


def test_a_file_that_shrank_is_an_error(spark, tmp_path):
    written(tmp_path, big=2_000)
    listed = spark.createDataFrame([(f"file:{tmp_path}/big.bin", 2_001)], "path string, length long")
    with pytest.raises(Exception, match="ends 1 bytes before"):
        digests.stream_digests(listed).collect()


def test_ingestion_by_tree_skips_what_it_has_seen(spark, sf, folder):
    cases(spark, sf).limit(200).write.parquet(folder("in.parquet"))
    config = ingest.IngestConfig(
        folder("in.parquet"), folder("out"), date(2001, 12, 31), min_date="1995-01-01", fingerprint="tree"
    )
    assert [ingest.run_pipeline(spark, config) for _ in range(2)] == ["completed", "skipped"]
