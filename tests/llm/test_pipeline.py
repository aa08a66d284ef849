import zlib

import numpy as np
import pytest

import corpus_pipeline
from barweave.llm import jaccard
from barweave.session import stored

from .test_decontaminate import brute as contaminated
from .test_jaccard import shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DATA)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_pass(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
    assert [len(s.columns) for s in steps[-1:]] == [7]
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_good(spark, steps):
    kept = set(texts(steps[1]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [d in kept for d, q in labels.items() if q == 1]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    sets = {d: shingles(t) for d, t in before.items()}
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not [(a, b) for a in after for b in after if a < b and near(a, b)]
    # what went is reachable from something smaller that stayed
    part = {r.doc_id: r.component_id for r in jaccard.report(steps[1]).collect()}
    assert set(after) == set(part.values())


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    judged = contaminated(sorted(texts(steps[2]).items()), items)
    assert set(texts(steps[3])) == {d for d, *_, bad in judged if not bad}


def test_personal_data_goes_and_clean_texts_stay(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d] != after[d]]
    assert all(any(c in "@0123456789" for c in before[d]) for d in changed)


def test_everything_is_packed(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = steps[5].toPandas()
    whole = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts(steps[4]).items()}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in whole.items()}
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())


def test_odd_rows(spark, make, odd, clash):
    docs = clash(make(odd))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
