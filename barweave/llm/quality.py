"""Quality classifier: a sparse rule ensemble over text statistics.

1. One pass over the texts gives some twenty statistics a document.
2. A random forest of shallow trees is grown on the labelled rows with Spark ML; every path from a root to a node
   becomes a conjunctive rule.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The rules that are left are compiled into one Spark column over the statistics.

All labelled rows are learned from, in Spark; nothing is sampled.

Edge cases: a null or empty text has all statistics zero and is scored like any other; rows without a label are not learned
from; each label row of a repeated id counts; with labels of one kind only, or none, every score is the smoothed share of
good labels; a null id is never held out; the score's columns replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import texts

TREES = 24
DEPTH = 3
LASSO = 0.002
SEED = 7

STATS = [
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "symbols", "stops", "spaces", "newlines", "wide", "doubled_symbols", "marked_words", "bars",
    "distinct_words", "top_word", "repeated_fives", "line_bytes", "repeated_lines", "distinct_bytes",
]

_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,;:?'\"()-")] = True
_PRINT = np.zeros(256, dtype=bool)
_PRINT[[b for b in range(33, 127) if not chr(b).isalnum() and not _STOPS[b]]] = True
_LINES = texts._table(b"\n")


def _share(a, b):
    return a / np.maximum(b, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    data, offsets = texts.utf8(column)
    w = texts.Words(data, offsets, texts.SPACES, False)
    lines = texts.Words(data, offsets, _LINES, False)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n, n_words, n_lines = np.diff(offsets), np.diff(w.first), np.diff(lines.first)
    lower, upper = total((data >= 97) & (data <= 122)), total((data >= 65) & (data <= 90))
    wide = total(data >= 128)
    letters = lower + upper + wide
    symbol = _PRINT[data]
    doubled = symbol.copy()
    if len(data):
        doubled[0] = False
        doubled[1:] &= data[1:] == data[:-1]
    length = w.ends - w.starts
    by_word = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[w.first])
    distinct, top, fives, same_lines, kinds = (np.zeros(len(n)) for _ in range(5))
    grams = texts.windows(w.hashes, 5)
    for d in range(len(n)):
        i, j = w.first[d], w.first[d + 1]
        if j > i:
            _, counts = np.unique(w.hashes[i:j], return_counts=True)
            distinct[d], top[d] = len(counts) / (j - i), counts.max() / (j - i)
        if j - i >= 5:
            fives[d] = 1 - len(np.unique(grams[i : j - 4])) / (j - i - 4)
        a, b = lines.first[d], lines.first[d + 1]
        if b > a:
            same_lines[d] = 1 - len(np.unique(lines.hashes[a:b])) / (b - a)
        if n[d]:
            kinds[d] = np.count_nonzero(np.bincount(data[offsets[d] : offsets[d + 1]], minlength=256)) / np.sqrt(n[d])
    return np.stack(
        [
            np.log1p(n), np.log1p(n_words), _share(by_word(length), n_words), _share(by_word(length > 24), n_words), _share(upper, letters), _share(total((data >= 48) & (data <= 57)), n), _share(total(symbol), n),
            _share(total(_STOPS[data]), n), _share(total(data == 32), n), _share(total(data == 10), n), _share(wide, n), _share(total(doubled), n), _share(by_word(symbol[w.ends - 1]), n_words), _share(total(data == 124), n),
            distinct, top, fives, _share(n, n_lines), same_lines, kinds,
        ],
        axis=1,
    )


def with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the array ``_stats`` of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.parts(batch, "_text"):
                values = statistics(part.column("_text"))
                first = np.arange(len(values) + 1) * len(STATS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts.lists(values.ravel(), first, pa.float64())], [*part.schema.names[:-1], "_stats"])

    texts.small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["_stats array<double>"])
    return source.mapInArrow(count, schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Test:
    """One comparison of a statistic with a bound."""

    stat: int
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.element_at("_stats", self.stat + 1)
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{STATS[self.stat]} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Test, ...]


def paths(tree: str) -> list[Rule]:
    """The path to each node below the root, from Spark ML's printed form of a tree."""
    out: list[Rule] = []
    trail: list[tuple[int, Test]] = []
    for line in tree.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            trail = [x for x in trail if x[0] < depth] + [(depth, Test(int(m[2]), m[3] == ">", float(m[4])))]
            out.append(tuple(t for _, t in trail))
    return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of good quality as a column over ``_stats``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = rule[0].column()
            for t in rule[1:]:
                test = test & t.column()
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join(f"{w:+.3f} {' and '.join(map(str, r))}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1])))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Learn from the columns ``_stats`` and ``label`` (0 or 1)."""
    rows = rows.where("label IS NOT NULL").select(array_to_vector("_stats").alias("features"), "_stats", F.col("label").cast("double").alias("label"))
    counts = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    prior = Ensemble(float(np.log((good + 1) / (bad + 1))), [])
    if not bad or not good:
        return prior
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED).fit(rows)
    found = sorted({tuple(sorted(set(r), key=lambda t: (t.stat, t.above, t.bound))) for tree in forest.trees for r in paths(tree.toDebugString)}, key=str)
    if not found:
        return prior
    hits = []
    for rule in found:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        hits.append(test.cast("double"))
    train = rows.select("label", array_to_vector(F.array(*hits)).alias("features"))
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=100, tol=1e-6).fit(train)
    return Ensemble(float(model.intercept), [(r, float(w)) for r, w in zip(found, model.coefficients.toArray()) if w])


def _training(documents: DataFrame, labels: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    label = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).where(F.col("label").isNotNull() & ~held_out("_id"))
    rows = stats if stats is not None else with_statistics(documents.select("doc_id", "text").join(label.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_semi"), ["doc_id"])
    return rows.join(label, F.col("doc_id") == F.col("_id")).select("_stats", "label")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document. The statistics are taken once and stored for the fit and the scores."""
    stats = stored(with_statistics(documents, ["doc_id"]))
    model = fit(stored(_training(documents, labels, stats)))
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.5 or more, with their own columns."""
    model = fit(stored(_training(documents, labels)))
    names = documents.columns
    hidden = documents.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)] + [F.col("text")])
    scored = with_statistics(hidden, [f"c{i}" for i in range(len(names))]).where(model.score() >= 0.5)
    return scored.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
