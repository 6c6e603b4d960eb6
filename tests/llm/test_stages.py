"""Stages of the pipeline on repeated keys, nulls, empty tables and columns with clashing names."""

import pytest

import corpus_pipeline as P

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def documents(spark, rows):
    """Rows (doc_id, text) with columns named like working ones."""
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 42, f"c{i}", "r") for i, (k, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, text_digest int, copy string, row_key string")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_dedup_tells_rows_by_text(spark, sf_dir):
    other = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(5, WORDS), (5, other), (3, WORDS), (3, WORDS), (None, WORDS), (None, other + " x"), (7, None), (8, ""), (8, ""), (9, WORDS + " end")])
    got = P.drop_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert kept(got) == sorted([(3, WORDS), (5, other), (7, None), (8, "")], key=repr)
    assert {(r["text_digest"], r["row_key"]) for r in got.collect()} == {(42, "r")} and all(r["copy"].startswith("c") for r in got.collect())


def test_near_dedup_of_rows_without_keys(spark, sf_dir):
    docs = documents(spark, [(None, WORDS), (None, WORDS), (None, WORDS + " end"), (None, "quite another text of some words")])
    got = kept(P.drop_near_copies(spark, docs, sf_dir))
    assert len(got) == 2 and (None, "quite another text of some words") in got


@pytest.mark.parametrize("name, stage", P.STAGES[1:4])
def test_stages_keep_columns_and_take_no_rows(spark, sf_dir, name, stage):
    docs = documents(spark, [(1, "alone here"), (2, None), (None, ""), (2, "alone there")])
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == 4
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
