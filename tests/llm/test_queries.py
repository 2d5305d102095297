"""Every numbered query: against its SQL where it has some, else shape and whole coverage of its table."""

import pytest
from compare import difference, duck

import corpus_pipeline
from casemill.llm.queries import ORACLE, QUERIES

ONE_ROW_PER_DOCUMENT = ("op2_token_counts", "op3_lm_scores", "op7_suffix_dedup", "op8_toxicity", "op10_jaccard_join", "op13_byte_bpe")


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLE)
def test_matches_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), duck(sf), ORACLE[name]) is None


@pytest.mark.parametrize("name", ONE_ROW_PER_DOCUMENT)
def test_covers_the_table(spark, sf, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, sf).select("doc_id").collect()) == ids


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
