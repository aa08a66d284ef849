"""Language identification with interpolated Kneser-Ney character models, one for each language.

Letters of each word, lower-cased and framed by word boundaries, are predicted from up to ``ORDER - 1`` characters before
them. A model is a set of sorted 64-bit hash arrays, one for each order, with a probability and a back-off weight for each
language next to each hash. A text goes to the language with the lowest cross-entropy per character.

The models are fitted on at most ``FIT_DOCS`` labelled texts a language, those lowest in a hash order, and the
score's logistic curve and the rejection limits on at most ``CALIBRATE_DOCS`` other ones a language. Scoring reads every whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned; rows with a null
language are not learned from; repeated rows count as often as they occur; a null id is never held out; ties go to the
language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import texts

ORDER = 4
FIT_DOCS = 2000
CALIBRATE_DOCS = 500
#: Share of the calibration texts of a language whose cross-entropy lies below the rejection limit.
KEPT = 0.995
#: Bytes of text scored at a time.
RUN = 1 << 20
_EDGE = 10


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _alphas(points: np.ndarray) -> np.ndarray:
    kinds = np.unique(points)
    return kinds[[chr(int(c)).isalpha() for c in kinds]] if len(kinds) else kinds


def streams(w: texts.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the picked words' letters, each word between two boundaries, and the place of each word's first boundary."""
    raw = w.data.tobytes()
    joined = "\n" + "\n".join([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[pick], w.ends[pick])]) + "\n"
    points = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    points = points[np.isin(points, _alphas(points)) | (points == _EDGE)]
    return points, np.flatnonzero(points == _EDGE)[:-1]


def _depth(points: np.ndarray) -> np.ndarray:
    """Characters between each place and the boundary that opens its word; 0 is the boundary that opens the first word."""
    edge = np.flatnonzero(points == _EDGE)
    opened = edge[np.maximum(np.searchsorted(edge, np.arange(len(points)), side="left") - 1, 0)]
    return np.arange(len(points)) - opened


def grams(points: np.ndarray, depth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last character, hash) of each k-gram that lies in one word."""
    at = np.flatnonzero(depth >= max(1, k - 1)) if k > 1 else np.flatnonzero(depth >= 1)
    values = texts.mixed(points.astype(np.uint64) + np.uint64(77))
    return at, texts.span_hashes(values, at - k + 1, at + 1)


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]
    prob: list[np.ndarray]  # one row a gram, one column a language; NaN: not seen
    back: list[np.ndarray]  # weight of the shorter context after this gram; 1: not seen
    floor: np.ndarray
    scale: tuple[float, float] = (0.0, 1.0)
    limit: np.ndarray | None = None

    def bits(self, points: np.ndarray) -> np.ndarray:
        """-log2 of each character's probability: one row a place, one column a language; rows of word openings are zero."""
        depth = _depth(points)
        p = np.tile(self.floor, (len(points), 1))
        before = None
        for k in range(1, len(self.keys) + 1):
            at, h = grams(points, depth, k)
            keys = self.keys[k - 1]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            place[keys[place] != h] = -1
            if k > 1:
                if k == 2:  # the opening boundary is a context too
                    context = np.where(depth[at] == 1, self.edge_place, before[at - 1])
                else:
                    context = before[at - 1]
                p[at] *= np.where((context >= 0)[:, None], self.back[k - 2][context], 1.0)
            got = self.prob[k - 1][place]
            p[at] = np.where((place >= 0)[:, None] & ~np.isnan(got), got, p[at])
            before = np.full(len(points), -1)
            before[at] = place
        out = -np.log2(p)
        out[depth < 1] = 0
        return out

    @property
    def edge_place(self) -> int:
        h = texts.span_hashes(texts.mixed(np.array([_EDGE], dtype=np.uint64) + np.uint64(77)), np.array([0]), np.array([1]))[0]
        place = min(int(np.searchsorted(self.keys[0], h)), len(self.keys[0]) - 1)
        return place if self.keys[0][place] == h else -1


_LETTER_WORDS = texts._table(bytes(b for b in range(128) if not chr(b).isalpha()))


def word_bits(models: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and characters predicted."""
    w = texts.words(column, _LETTER_WORDS, lower=True)
    total, chars = np.zeros((len(column), len(models.languages))), np.zeros(len(column))
    if not len(w.hashes):
        return total, chars
    _, pick, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    points, opened = streams(w, pick)
    bits, steps = models.bits(points), (np.arange(len(points)) > 0).astype(float)
    stop = np.append(opened[1:], len(points) - 1)
    size = stop - opened - 1  # letters
    sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)])
    own = np.where((size > 0)[:, None], sums[stop + 1] - sums[opened + 1], 0.0)
    count = np.where(size > 0, size + 1, 0)
    filled = np.flatnonzero(np.diff(w.first))
    total[filled] = np.add.reduceat(own[back], w.first[filled], axis=0)
    chars[filled] = np.add.reduceat(count[back], w.first[filled])
    return total, chars


def _sample(documents: DataFrame, where: Column, most: int) -> DataFrame:
    """At most ``most`` different texts of each language, in the order of a hash of the text.

    Only hashes are ranked: counts in 4,096 cells of the hash tell up to which cell a language needs them, so few rows of a language meet in a
    task. Texts are fetched for the winners, at most ``most`` a language.
    """
    labelled = documents.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.withColumn("_h", F.xxhash64("text"))
    hashes = labelled.select("lang", "_h", F.shiftright("_h", 52).alias("_cell")).distinct()
    cells = hashes.groupBy("lang", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_cell")) - F.col("_n")
    last = cells.withColumn("_before", before).where(F.col("_before") < most).groupBy("lang").agg(F.max("_cell").alias("_last"))
    few = hashes.join(F.broadcast(last), "lang").where(F.col("_cell") <= F.col("_last"))  # a row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    winners = few.withColumn("_n", place).where(F.col("_n") <= most).select("lang", "_h")
    return labelled.join(F.broadcast(winners), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text")).drop("_h")


def count_grams(sample: DataFrame, order: int) -> pd.DataFrame:
    """lang, k, gram, n: how often each character n-gram occurs in the words of each language."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                langs = part.column("lang").to_pylist()
                w = texts.words(part.column("text"), _LETTER_WORDS, lower=True)
                code = {x: i for i, x in enumerate(sorted(set(langs)))}
                kind = np.array([code[x] for x in langs])[w.owners()]
                for lang, c in code.items():
                    _, pick, n = np.unique(w.hashes[kind == c], return_index=True, return_counts=True)
                    points, opened = streams(w, np.flatnonzero(kind == c)[pick])
                    text = points.astype("<u4").tobytes().decode("utf-32-le").split("\n")[1:-1]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text)), pa.array(text), pa.array(n[: len(text)], pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(words, "lang string, word string, n bigint").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    framed = counted.withColumn("word", F.concat(F.lit("\n"), "word", F.lit("\n")))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.col("word").substr(i, k))))
    pieces = framed.where(F.length("word") >= order).select("lang", "n", F.explode(cut).alias("gram"))
    short = framed.where(F.length("word") < order)
    some = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.col("word").substr(i, k))))
    pieces = pieces.unionByName(short.select("lang", "n", F.explode(some).alias("gram")))
    # bounded by the sample
    return pieces.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("k", F.length("gram")).toPandas()


def kneser_ney(counts: pd.DataFrame, order: int) -> Models:
    """Interpolated Kneser-Ney: raw counts for the longest context of a place, numbers of distinct characters before for shorter ones."""
    languages = sorted(counts["lang"].unique())
    probs, backs, floors = [{} for _ in range(order)], [{} for _ in range(order)], []
    for column, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        by = {k: dict(zip(g["gram"], g["n"])) for k, g in own.groupby("k")}
        alphabet = len(by[1])
        floor = 1 / (alphabet + 1)
        floors.append(floor)
        lower: dict[str, float] = {}
        for k in range(1, order + 1):
            table = dict(by.get(k, {}))
            if k < order:  # distinct left neighbours, but a gram that opens a word has none
                left: dict[str, int] = {}
                for g in by.get(k + 1, {}):
                    left[g[1:]] = left.get(g[1:], 0) + 1
                table = {g: (n if g[0] == "\n" and k > 1 else left.get(g, 0)) for g, n in table.items()}
            table = {g: n for g, n in table.items() if n}
            ones, twos = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            sums: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, n in table.items():
                sums[g[:-1]] = sums.get(g[:-1], 0) + n
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            weight = {h: discount * kinds[h] / sums[h] for h in sums}
            now = {g: (n - discount) / sums[g[:-1]] + weight[g[:-1]] * (lower.get(g[1:], floor) if k > 1 else floor) for g, n in table.items()}
            if k == 1:  # a character that the language has not
                floors[-1] = weight.get("", 1.0) * floor
            for g, p in now.items():
                probs[k - 1].setdefault(g, {})[column] = p
            if k > 1:
                for h, x in weight.items():
                    backs[k - 2].setdefault(h, {})[column] = x
            lower = now
    keys, prob, back = [], [], []
    for k in range(order):
        names = sorted(probs[k].keys() | backs[k].keys()) or ["\0" * (k + 1)]
        points = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
        begin = np.arange(len(names)) * (k + 1)
        h = texts.span_hashes(texts.mixed(points.astype(np.uint64) + np.uint64(77)), begin, begin + k + 1)
        order_ = np.argsort(h)
        p, b = np.full((len(names), len(languages)), np.nan), np.ones((len(names), len(languages)))
        for i, g in enumerate(names):
            for c, x in probs[k].get(g, {}).items():
                p[i, c] = x
            for c, x in backs[k].get(g, {}).items():
                b[i, c] = x
        keys.append(h[order_])
        prob.append(p[order_])
        back.append(b[order_])
    return Models(languages, keys, prob, back, np.array(floors))


def _margin(total: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its bits a character, and its lead in bits over the next, damped for long texts."""
    entropy = total / np.maximum(chars, 1)[:, None]
    best = entropy.argmin(axis=1) if entropy.shape[1] else np.zeros(len(entropy), dtype=int)
    ranked = np.sort(entropy, axis=1)
    lead = (ranked[:, 1] - ranked[:, 0]) if entropy.shape[1] > 1 else np.full(len(entropy), 1.0)
    return best, ranked[:, 0], lead * np.sqrt(np.maximum(chars, 1))


def _scored(models: Models, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.parts(batch, "_text", RUN):
                keep = part.columns[:-1]
                total, chars = word_bits(models, part.column("_text"))
                best, entropy, lead = _margin(total, chars)
                known = chars > 0
                a, b = models.scale
                sure = np.where(known, 1 / (1 + np.exp(-np.clip(a + b * lead, -50, 50))), 0.0)
                lang = [models.languages[i] if x else "und" for i, x in zip(best, known)]
                limit = models.limit[best] if models.limit is not None else np.full(len(best), np.inf)
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(lang, pa.string()), pa.array(sure), pa.array(np.where(known, entropy, 0.0)), pa.array(~known | (entropy > limit))], [*names, "lang_pred", "score", "cross_entropy", "rejected"]
                )

    return score


def _calibrated(models: Models, sample: DataFrame) -> Models:
    """Fit the logistic curve of the lead and the rejection limits on labelled texts that the models have not seen."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                total, chars = word_bits(models, part.column("text"))
                best, entropy, lead = _margin(total, chars)
                right = [models.languages[i] == x for i, x in zip(best, part.column("lang").to_pylist())]
                some = pa.array(chars > 0)
                yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(entropy), pa.array(right, pa.bool_()), part.column("lang")], ["lead", "entropy", "good", "lang"]).filter(some)

    rows = sample.mapInArrow(measure, "lead double, entropy double, good boolean, lang string").toPandas()  # bounded by the sample
    # two pseudo rows keep the curve finite when every text is right
    x = np.append(rows["lead"].to_numpy(), [0.0, 0.0])
    y = np.append(rows["good"].to_numpy().astype(float), [0.0, 1.0])
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        s = p * (1 - p)
        h = np.array([[s.sum() + 1e-3, (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    models.scale = (float(a), max(float(b), 1e-6))
    good = rows[rows["good"]]
    models.limit = np.array([np.quantile(e, KEPT) * 1.1 if len(e := good.loc[good["lang"] == lang, "entropy"].to_numpy()) >= 20 else np.inf for lang in models.languages])
    return models


def fit(documents: DataFrame, order: int = ORDER, fit_docs: int = FIT_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Models | None:
    """Models from the rows whose remainder is 0 or 1 (or null), calibrated on those with remainder 3."""
    counts = count_grams(_sample(documents, F.coalesce(remainder(), F.lit(0)) < 2, fit_docs), order)
    if counts.empty:
        return None
    return _calibrated(kneser_ney(counts, order), _sample(documents, remainder() == 3, calibrate_docs))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, with its cross-entropy and whether the winning model finds it odd (``rejected``)."""
    texts.small_batches(documents.sparkSession)
    models = fit(documents)
    source = documents.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("_text"))
    if models is None:
        return source.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scored(models, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
