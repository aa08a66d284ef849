import itertools
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from barweave.llm import audit

from .conftest import SCHEMA


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def brute(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None and i <= least.get(text or "", i):
            least[text or ""] = i
    seen = []
    for i, text, lang, *_ in docs:
        flags = failed(text or "") + [i is not None and i > least[text or ""]]
        good, toxic = (any(n == i and row[at] == 1 for n, *row in labels if i is not None) for at in (0, 1))
        seen.append((lang or "", flags, good, toxic))
    removed, out = Counter(), {}
    for part in {s[0] for s in seen}:
        for order in itertools.permutations(range(5)):
            name, left = "".join("ABCDE"[j] for j in order), [s for s in seen if s[0] == part]
            for step, j in enumerate(order, 1):
                mine = [s for s in left if s[1][j]]
                failing = sum(s[1][j] for s in seen if s[0] == part)
                only = sum(s[1][j] and sum(s[1]) == 1 for s in seen if s[0] == part)
                left = [s for s in left if not s[1][j]]
                removed[part, "ABCDE"[j]] += len(mine)
                out[part, name, step] = [len(left), len(mine), failing - len(mine), only, sum(s[2] for s in mine), sum(s[3] for s in mine)]
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def some_documents(odd):
    rng = random.Random(9)
    docs = [(i, t, rng.choice(["en", "de", None, ""]), "s", 0) for i, t in odd]
    base = [" ".join(f"{rng.choice(['w', 'W', 'é'])}{rng.randrange(k)}" for _ in range(n)) + mark for n in (0, 5, 99, 100, 130) for k in (40, 900) for mark in ("", " 5 %", " ABCDEFGHIJ" * 9)]
    docs += [(rng.randrange(100, 2000), rng.choice(base), rng.choice(["en", "de", "fr"]), "s", 0) for _ in range(220)]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for d in docs if rng.random() < 0.6]
    return docs, labels + [(None, 1, 1)]


@pytest.mark.parametrize("order", ["falling", "mixed"])
def test_brute_force_over_files(spark, odd, clash, tmp_path, order):
    """Smaller ids come in later files, so earlier counts are taken back."""
    docs, labels = some_documents(odd)
    docs.sort(key=lambda d: -(d[0] or 0))
    if order == "mixed":
        random.Random(2).shuffle(docs)
    path = str(tmp_path / "documents.parquet")
    for k in range(5):
        clash(spark.createDataFrame(docs[k::5] if order == "mixed" else docs[len(docs) * k // 5 : len(docs) * (k + 1) // 5], SCHEMA)).coalesce(1).write.mode("append").parquet(path)
    for k, file in enumerate(sorted((f for f in tmp_path.rglob("*.parquet") if f.is_file()), key=os.path.getmtime)):
        os.utime(file, (10_000 + k, 10_000 + k))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(map(tuple, audit.report(spark, path, table, batches=5).collect()))
    assert got == brute(docs, labels)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(docs, SCHEMA).toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", table.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert sorted(con.execute(audit.SQL).fetchall()) == got


def test_hot_text_and_repeated_rows(spark, tmp_path):
    """A third of the rows share one text; rows with one id and text do not make each other fail."""
    docs = [(3000 - k, "same text" if k % 3 == 0 else f"text {k}", "en", "s", 0) for k in range(3000)] + [(1, "twice", "en", "s", 0)] * 3
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, SCHEMA).repartition(6).write.parquet(path)
    counts = {r.mask: r.n for r in audit.counted(spark, path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), batches=3).collect()}
    assert counts == {1: 2000 + 1 + 3, 17: 999}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert audit.report(spark, path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
