import zlib

import numpy as np
import pytest

from barweave.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def table(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(table):
    docs, labels = table
    got = quality.report(docs, labels).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert (held.loc[held["quality"] == 1, "predicted"]).mean() > 0.97


def test_rules_are_paths_and_sparse(spark, table):
    docs, labels = table
    model = quality.fit(quality._training(docs, labels))
    assert 0 < len(model.rules) < quality.TREES * 2 ** (quality.DEPTH + 1)
    assert all(1 <= len(rule) <= quality.DEPTH and weight for rule, weight in model.rules)
    # the compiled column agrees with the rules taken one by one
    rows = quality.with_statistics(docs.limit(50), ["doc_id"]).withColumn("s", model.score()).collect()
    for r in rows:
        total = model.intercept
        for rule, weight in model.rules:
            if all((r._stats[t.stat] > t.bound) == t.above for t in rule):
                total += weight
        assert abs(r.s - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark, make, odd, clash):
    docs = clash(make(odd))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (12, 0, 0), (99, 0, 0), (None, 1, 0), (7, None, None)], LABELS)
    got = quality.report(docs, labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.report(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == len(odd)
    good = spark.createDataFrame([(i, 1, 0) for i in range(1, 16)], LABELS)
    assert all(r.score > 0.5 for r in quality.report(docs, good).collect())
    assert quality.report(docs.limit(0), labels).count() == 0


def test_equal_texts_have_equal_scores(spark, make, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)], LABELS)
    got = {}
    for r in quality.report(make(odd), labels).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert got[1] == got[2] and got[4] == got[5]
