import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from barweave.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.report(docs.select("doc_id", "text", "lang")).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both["held_out"] & both["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and got["rejected"].mean() < 0.05


def brute(counts, order):
    """Interpolated Kneser-Ney of one language, by definition: probability of a character after a context."""
    by = {k: {g: n for g, n in counts.items() if len(g) == k} for k in range(1, order + 1)}
    tables = {}
    for k in range(1, order + 1):
        if k == order:
            tables[k] = by[k]
        else:
            tables[k] = {g: (n if g[0] == "\n" and k > 1 else len({x[0] for x in by[k + 1] if x[1:] == g})) for g, n in by[k].items()}
        tables[k] = {g: n for g, n in tables[k].items() if n}

    def p(context, c):
        k = len(context) + 1
        if k == 0:
            return 1 / (len(by[1]) + 1)
        t = tables[k]
        shorter = p(context[1:], c) if context else 1 / (len(by[1]) + 1)
        ones, twos = list(t.values()).count(1), list(t.values()).count(2)
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(n for g, n in t.items() if g[:-1] == context)
        if not total:
            return shorter
        kinds = sum(g[:-1] == context for g in t)
        n = t.get(context + c, 0)
        return max(n - d, 0) / total * (n > 0) + d * kinds / total * shorter

    return p


def test_models_are_kneser_ney(spark, make):
    texts = {"aa": "banana bandana cabana ban nab", "bb": "nab kayak kayaks bask task"}
    sample = spark.createDataFrame([(k, v) for k, v in texts.items()], "lang string, text string")
    counts = language.count_grams(sample, 3)
    models = language.kneser_ney(counts, 3)
    points = np.frombuffer("\nbanana\nzab\n".encode("utf-32-le"), dtype=np.uint32)
    bits = models.bits(points)
    for column, lang in enumerate(models.languages):
        own = counts[counts["lang"] == lang]
        p = brute(dict(zip(own["gram"], own["n"])), 3)
        text = "\nbanana\nzab\n"
        for i in range(1, len(text)):
            start = text.rfind("\n", 0, i)
            assert abs(bits[i, column] + np.log2(p(text[max(start, i - 2) : i], text[i]))) < 1e-9, (lang, i)
    total, chars = language.word_bits(models, pa.array(["Banana ZAB 12", None, "12 --", "banana"]))
    assert chars.tolist() == [11, 0, 0, 7] and abs(total[0] - bits.sum(axis=0)).max() < 1e-9


def test_odd_rows(spark, make, odd, clash):
    docs = [*odd, (50, "12 345 — ١٢"), (51, "ß"), (52, "…")]
    got = language.report(clash(make(docs))).collect()
    assert len(got) == len(docs)
    for r in got:
        texts = [t for i, t in docs if i == r.doc_id]
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred == "en" and 0 <= r.score <= 1
    unlabelled = make(odd).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r.lang_pred for r in language.report(unlabelled).collect()} == {"und"}
    assert language.report(make(odd).limit(0)).count() == 0


def test_fit_is_bounded(spark, make):
    docs = make([(k, f"word{chr(97 + k % 26)} text") for k in range(1, 400, 2)])
    assert language._sample(docs, language.F.lit(True), 7).count() == 7
    assert isinstance(language.count_grams(docs.select("lang", "text"), 2), pd.DataFrame)
