from casemill.llm import quality_rules as q


def measures(spark, *texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    return [r.asDict() for r in q.judged(docs).orderBy("doc.doc_id").collect()]


def test_counts_by_hand(spark):
    null, empty, lines, repeat = measures(spark, None, "", "a b\n\n a b\na b\n\x0b\na b\n# <x>", "x y z x y z x y")
    for row in (null, empty):
        assert row["n_words"] == row["word_chars"] == row["n_repeat_words"] == 0 and row["base_failed"] and not row["kept"]
    assert (lines["n_words"], lines["n_lines"], lines["n_dup_lines"], lines["n_symbols"]) == (10, 5, 2, 3)
    assert lines["n_repeat_words"] == 8 and lines["word_chars"] == 12
    assert repeat["n_repeat_words"] == 8


def test_brute_force_windows(spark):
    import random

    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    for text, row in zip(texts, measures(spark, *texts)):
        w = text.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
        assert row["n_repeat_words"] == len(covered)


def test_long_text_and_clean_text(spark):
    clean = "\n".join(f"the word{i} of the text{i} and more{i} things{i}" for i in range(12))
    kept, junk, long = measures(spark, clean, clean.replace("of", "#$% |"), "spam " * 200_000)
    assert kept["kept"] and kept["failed_rules"] == []
    assert not junk["kept"] and "symbols" in junk["failed_rules"]
    assert long["base_failed"] and long["n_repeat_words"] == 200_000


def test_keep_good_keeps_rows_and_columns(spark):
    clean = "\n".join(f"the word{i} of the text{i} and more{i} things{i}" for i in range(12))
    docs = spark.createDataFrame([(None, clean, 1), (None, clean, 1), (3, "no", 2)], "doc_id int, text string, doc int")
    out = q.keep_good(docs)
    assert out.columns == docs.columns and out.count() == 2
    assert q.keep_good(docs.limit(0)).count() == 0
