import hashlib
import random
import re

import pytest

from barweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            size = min(13, len(v))
            if item_id is None or not size:
                continue
            runs = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in runs:
                    hit |= set(range(i, i + size))
                    found.add(item_id)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400])
def test_brute_force(spark, make, odd, block_bytes):
    rng = random.Random(1)
    some = ["a", "b", "c", "Dd", "é", "f7", "G"]
    line = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(some) for _ in range(n))
    items = [(k, line(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for k in range(20)] + [(3, "one"), (30, None), (31, "..."), (None, "a b"), (32, odd[0][1])]
    docs = odd + [(100 + k, line(rng.choice([0, 1, 4, 40, 150])) + " " + rng.choice(items)[1].__str__()) for k in range(60)]
    got = decontaminate.report(make(docs), spark.createDataFrame(items, ITEMS), ["doc_id"], block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_keeps_columns_and_empty_tables(spark, make, odd, clash):
    docs, none = clash(make(odd)), spark.createDataFrame([], ITEMS)
    kept = decontaminate.decontaminate(docs, none)
    assert kept.schema.names == docs.schema.names and kept.count() == len(odd)
    items = spark.createDataFrame([(1, odd[0][1])], ITEMS)
    left = decontaminate.decontaminate(docs, items)
    assert left.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted(i for i, t in odd if i and not (t or "").lower().startswith(odd[0][1].lower()))
    assert decontaminate.report(docs.limit(0), items, ["doc_id"]).count() == 0


def test_windows_with_one_frequent_shingle(spark, make):
    """Every shingle of the windows is frequent: candidates are many, results exact."""
    docs = [(k, "a a a a a b " * 30 + "c") for k in range(8)]
    items = [(1, "a " * 13), (2, "a a a a a b a a a a a b a"), (3, "b c")]
    got = decontaminate.report(make(docs), spark.createDataFrame(items, ITEMS), ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
