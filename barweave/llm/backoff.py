"""Language-model scores by stupid back-off over the corpus's own bigrams, computed relationally.

S(b | a) = c(a b) / c(a) if the pair occurs at least ``seen`` times in the corpus, else ``BACKOFF`` * c(b) / N; a text's first word has
c(b) / N. ``seen`` is 1 unless a caller asks for more, so every counted pair is scored by its count. Words are runs without white space, A-Z lower-cased; every word is told apart, by its 64-bit hash. A document's score is the sum of
log10 S over its words, and the mean of it. (A caller may ask for one unknown word instead of the words rarer than one in ``share``.)
As the model is the corpus's own, every bigram it scores is counted in it: at ``seen`` = 1 the back-off term is never the one that holds, and nothing is scored by it.

At a higher ``order`` k a word has c(its k words) / c(the k - 1 before it). Adjacent runs of k - 1 words overlap, so a pair of them is one run of k words:
the same steps then count and score runs of k - 1 words in place of words. The first k - 1 words' factors multiply to c(first run) / N; a shorter
document has c(all its words in a row) / N, looked up in counts of its length.

1. Word counts over all documents; those of the common words, at least one in ``COMMON`` of all words (so at most ``COMMON`` of them), are sent to every
   task.
2. Bigrams found in one document of ``FREQUENT`` or more (in runs of documents, so at most ``FREQUENT`` times the bigrams of an average document) are
   counted exactly over all documents; their part of a score is added up where the document is read, so no bigram has rows from a large share of the documents.
3. All other bigrams of a document go to a bucket, as entries of bigram, document and times: those of common words by the bigram, the others by
   their first word that is not common. A bucket's entries travel in sorted, compressed blocks. A bucket has all entries of its bigrams, so their counts, and
   all of its words that are not common (each occurrence is a first word or a document's last), so the counts of those words. Nothing else is looked up,
   but the second word of a bigram that is seen too seldom (``seen`` above 1 only), in the table of word counts.
4. The parts are summed for each document.

Edge cases: a null or empty text has no words, score 0 and a null mean; repeated rows and null ids are documents of their own, each counted; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..session import stored
from . import texts
from .decontaminate import Lookup

#: Share of all words from which on a word is told apart: any.
KNOWN = math.inf
COMMON = 1 << 20
FREQUENT = 256
#: Words added up by a task before it hands them on, and bytes of text taken at a time.
MEMORY = 1 << 20
RUN = 1 << 21
SEEN = 1
#: Words of the longest counted run; the query scores bigrams.
ORDER = 2
#: Parts of a score are whole numbers of 1 / ``UNIT``, so that they add up to the same sum in any order.
UNIT = 1_000_000_000
BACKOFF = 0.4


class Vocabulary:
    """Word numbers by hash; the number ``size`` is the unknown word, or any word that is not common if the vocabulary is ``open``."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, open_: bool) -> None:
        order = np.argsort(words)
        self.lookup = Lookup(words[order])
        self.size, self.width = len(words), len(words) + 1
        self.counts = np.zeros(self.width, dtype=np.int64)
        self.counts[: len(words)] = counts[order]
        self.counts[-1] = total - counts.sum()
        self.total, self.open = total, open_

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.size, dtype=np.int64)
        at, place = self.lookup.find(hashes)
        out[at] = place
        return out

    def names(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The numbers of common words, and the hashes of the others, none of which is such a number."""
        value = hashes.view(np.int64)
        return np.where(ids < self.size, ids, np.where((value >= 0) & (value < self.size), value | np.int64(-(2**63)), value))

    def name(self, word):
        """``names`` as a column, for words that are not common."""
        return F.when((word >= 0) & (word < self.size), word + F.lit(-(2**63))).otherwise(word)


def _tally(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of equal values."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs(column: pa.Array, size: int) -> tuple[texts.Words, np.ndarray]:
    """The words of each text, or its runs of ``size`` words in their place, and its number of words."""
    w = texts.words(column, lower=True)
    n_words = np.diff(w.first)
    if size > 1:
        at = np.flatnonzero(w.left() >= size)
        w.hashes = texts.windows(w.hashes, size)[at]
        w.first = np.searchsorted(at, w.first)
    return w, n_words


def _words(size: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n) of a task, added up as far as memory allows; runs of ``size`` words count as words."""
        value, count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["word", "n"])

        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                v, c = np.unique(_runs(part.column("text"), size)[0].hashes, return_counts=True)
                value, count = _tally(np.concatenate([value, v]), np.concatenate([count, c]))
                if len(value) > MEMORY:
                    yield row()
                    value, count = value[:0], count[:0]
        yield row()

    return words


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents, words) of a task."""
    docs = n = 0
    for batch in batches:
        data, offsets = texts.utf8(batch.column("text"))
        raw = data.tobytes()
        docs += batch.num_rows
        n += sum(len(raw[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:]))
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([n])], ["docs", "words"])


def vocabulary(counted: DataFrame, total: int, share: float, common: int) -> Vocabulary:
    open_ = math.isinf(share)
    rows = counted.where(F.col("n") * F.lit(common if open_ else share) >= total).toPandas()  # at most `common` or `share` words
    return Vocabulary(rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64), total, open_)


class Pairs:
    """Distinct bigrams of each of some documents: document, bigram, times; and each document's first word. With an open vocabulary, bigrams of
    common words only; the others are in ``rare``: document, kind, the word that is not common, the other word, times."""

    def __init__(self, column: pa.Array, known: Vocabulary, size: int = 1) -> None:
        w, self.n_words = _runs(column, size)
        ids = known.ids(w.hashes)
        filled = np.flatnonzero(np.diff(w.first))
        self.first_word = np.full(len(self.n_words), -1)
        self.first_word[filled] = ids[w.first[filled]]
        inner = np.flatnonzero(w.left() >= 2)
        owners = w.owners()
        self.rare = None
        if known.open:
            strange = ids == known.size
            mixed = strange[inner] | strange[np.minimum(inner + 1, len(ids) - 1)]
            first, last = w.first[filled], w.first[filled + 1] - 1
            self.rare = self._rare(known, w, ids, owners, inner[mixed], first[strange[first]], last[strange[last]])
            self.first_word[self.first_word == known.size] = -1
            inner = inner[~mixed]
        owner = owners[inner]
        gram = ids[inner] * known.width + ids[inner + 1]
        packed = np.sort((owner << 41) | gram)  # a batch has fewer than 2**22 rows, a bigram at most 41 bits
        cut = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, dtype=np.int64)
        self.n = np.diff(np.append(cut, len(packed)))
        self.owner, self.gram = packed[cut] >> 41, packed[cut] & ((1 << 41) - 1)

    @staticmethod
    def _rare(known: Vocabulary, w: texts.Words, ids: np.ndarray, owners: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
        names = known.names(w.hashes, ids)
        ahead = ids[at] == known.size
        kind = np.where(ahead, AHEAD, BEHIND)
        x, y = np.where(ahead, names[at], names[at + 1]), np.where(ahead, names[at + 1], names[at])
        packed = owners[at] * 8 + kind
        order = np.lexsort((y, x, packed))
        packed, x, y = packed[order], x[order], y[order]
        cut = np.flatnonzero(np.append(True, (packed[1:] != packed[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(at) else at
        n = np.diff(np.append(cut, len(at)))
        ends = np.concatenate([owners[last] * 8 + LAST, owners[first] * 8 + FIRST])
        packed, none = np.concatenate([packed[cut], ends]), np.zeros(len(ends), dtype=np.int64)
        return packed >> 3, packed & 7, np.concatenate([x[cut], names[last], names[first]]), np.append(y[cut], none), np.append(n, none + 1)


def _often(known: Vocabulary, size: int):
    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigrams that many documents of some run have."""
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                gram, n = np.unique(Pairs(part.column("text"), known, size).gram, return_counts=True)
                keep = n >= max(8, part.num_rows // 128)
                yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(n[keep], pa.int64())], ["gram", "n"])

    return often


def _exact(known: Vocabulary, grams: np.ndarray, size: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), dtype=np.int64)
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                pairs = Pairs(part.column("text"), known, size)
                place = np.minimum(np.searchsorted(grams, pairs.gram), len(grams) - 1)
                same = grams[place] == pairs.gram
                total += np.bincount(place[same], weights=pairs.n[same], minlength=len(grams)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total)], ["gram", "n"])

    return exact


def _log_scores(known: Vocabulary, gram: np.ndarray, count: np.ndarray, seen: int) -> np.ndarray:
    a, b = known.counts[gram // known.width], known.counts[gram % known.width]
    return np.where(count >= seen, np.log10(np.maximum(count, 1) / np.maximum(a, 1)), np.log10(BACKOFF * b / max(known.total, 1)))


#: Kinds of entries: a bigram of common words (x: its number); one whose first word x is not common (y: the second); one whose second word x alone is
#: not common (y: the first); a word x that is not common at the end of a document, and at its start.
COMMONS, AHEAD, BEHIND, LAST, FIRST = range(5)
#: Entries a task holds before it hands them on, and entries a bucket should have at most on average.
ENTRIES = 1 << 20
BUCKET = 1 << 19
_ROWS = "bucket int, doc bigint, n int, body binary, doc_id bigint, n_words bigint, score bigint"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_PARTS = pa.schema([(c, pa.int64()) for c in ("doc", "s", "doc_id", "n_words", "word", "times")])


def _press(columns: list[np.ndarray]) -> bytes:
    """Whole numbers by byte planes, the first column by its differences."""
    raw = np.stack([np.diff(columns[0], prepend=np.int64(0)), *columns[1:]]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes())


def _open(body: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8).reshape(-1, 8, n)
    out = raw.transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
    out[0] = np.cumsum(out[0])
    return out


def _explode(known: Vocabulary, grams: np.ndarray, counts: np.ndarray, seen: int, buckets: int, size: int):
    """Blocks of entries, and a row for each document with what is known of its score already; or, if it is shorter than a run, with its words' hash and number."""

    def blocks(held: list[tuple], first: int) -> pa.RecordBatch:
        x, y, doc, n, kind = (np.concatenate(c) for c in zip(*held))
        bucket = (texts.mixed(x.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(x)
        order = order[np.argsort(bucket[order], kind="stable")]
        bucket, columns = bucket[order], [c[order] for c in (x, y, doc - first, n, kind)]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
        to = np.append(at[1:], len(bucket))
        body = [_press([c[i:j] for c in columns]) for i, j in zip(at.tolist(), to.tolist())]
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), first), pa.int64()), pa.array(to - at, pa.int32()), pa.array(body, pa.binary()), none, none, none], _NAMES)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_docs = TaskContext.get().partitionId() << 24, 0
        value = _log_scores(known, grams, counts, seen) if len(grams) else np.zeros(0)
        held, n_held, start = [], 0, base
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                pairs = Pairs(part.column("text"), known, size)
                doc = base + n_docs + np.arange(part.num_rows)
                n_docs += part.num_rows
                if n_docs > 1 << 24:
                    raise ValueError("a task numbers 16,777,216 documents at most: use smaller input partitions")
                score = np.zeros(part.num_rows, dtype=np.int64)
                some = pairs.first_word >= 0
                score[some] = np.rint(np.log10(known.counts[pairs.first_word[some]] / known.total) * UNIT).astype(np.int64)
                same = np.zeros(len(pairs.gram), dtype=bool)
                if len(grams):
                    place = np.minimum(np.searchsorted(grams, pairs.gram), len(grams) - 1)
                    same = grams[place] == pairs.gram
                    np.add.at(score, pairs.owner[same], np.rint(pairs.n[same] * value[place[same]] * UNIT).astype(np.int64))
                rest = ~same
                none = np.zeros(np.count_nonzero(rest), dtype=np.int64)
                held.append((pairs.gram[rest], none, doc[pairs.owner[rest]], pairs.n[rest], none + COMMONS))
                n_held += len(none)
                if pairs.rare is not None:
                    owner, kind, x, y, n = pairs.rare
                    held.append((x, y, doc[owner], n, kind))
                    n_held += len(x)
                n_rows = part.num_rows
                short = (pairs.n_words > 0) & (pairs.n_words < size)
                if short.any():
                    w = texts.words(part.column("text"), lower=True)
                    at, to = w.first[:-1][short], w.first[1:][short]
                    score[short] = np.where(to - at == 1, w.hashes[at], texts.span_hashes(w.hashes, at, to)).view(np.int64)  # as in _runs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc % buckets, pa.int32()), pa.array(doc), pa.array(pairs.n_words, pa.int32(), mask=~short), pa.nulls(n_rows, pa.binary()), part.column("doc_id"), pa.array(pairs.n_words, pa.int64()), pa.array(score)], _NAMES
                )
                if n_held > ENTRIES:
                    yield blocks(held, start)
                    held, n_held, start = [], 0, base + n_docs
        if n_held:
            yield blocks(held, start)

    return explode


def _scored(counts: np.ndarray, width: int, total: int, seen: int):
    """The parts of a bucket: sums by document, the documents' own rows, and words whose count is still to be looked up."""
    total = max(total, 1)

    def scored(rows: pa.Table) -> pa.Table:
        full = rows.filter(pc.is_valid(rows["body"]))
        own = rows.filter(pc.is_null(rows["body"]))
        short = pc.is_valid(own["n"])  # the hash is asked for
        words = [pc.if_else(short, own["score"], None), pc.if_else(short, own["n"].cast(pa.int64()), None)]
        out = [pa.Table.from_arrays([own["doc"], pc.if_else(short, 0, own["score"]), own["doc_id"], own["n_words"], *words], schema=_PARTS)]
        blocks = []
        for doc, n, body in zip(full["doc"].to_pylist(), full["n"].to_pylist(), full["body"]):
            blocks.append(_open(body.as_py(), n))
            blocks[-1][2] += doc
        if not blocks:
            return out[0]
        x, y, doc, n, kind = np.concatenate(blocks, axis=1)
        del blocks
        value, known = np.zeros(len(x)), np.ones(len(x), dtype=bool)

        def occurrences(at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
            """Times of all entries with the same keys."""
            order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
            new = np.zeros(len(at), dtype=bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[order][1:] != k[order][:-1]
            group = np.cumsum(new) - 1
            c = np.empty(len(at), dtype=np.int64)
            c[order] = np.add.reduceat(n[at][order], np.flatnonzero(new))[group] if len(at) else 0
            return c

        at = np.flatnonzero(kind == COMMONS)
        c, a, b = occurrences(at, x[at]), counts[x[at] // width], counts[x[at] % width]
        value[at] = np.log10(np.where(c >= seen, c / np.maximum(a, 1), BACKOFF * np.maximum(b, 1) / total))
        at = np.flatnonzero(kind != COMMONS)
        if len(at):
            words, place = np.unique(x[at], return_inverse=True)
            k = kind[at]
            of_word = np.bincount(place, weights=np.where((k == AHEAD) | (k == LAST), n[at], 0), minlength=len(words))[place]
            c = occurrences(at, y[at], place, k)
            common = (y[at] >= 0) & (y[at] < width - 1)
            other = np.maximum(np.where(common, counts[np.where(common, y[at], 0)], 1), 1)
            value[at] = np.log10(
                np.select(
                    [k == FIRST, k == LAST, c >= seen],
                    [of_word / total, np.ones(len(at)), c / np.where(k == AHEAD, of_word, other)],
                    BACKOFF * np.where(k == AHEAD, other, of_word) / total,
                )
            )
            known[at] = ~((k == AHEAD) & (c < seen) & ~common)
            ask = at[~known[at]]
            none = pa.nulls(len(ask), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(doc[ask]), none, none, none, pa.array(y[ask]), pa.array(n[ask])], schema=_PARTS))
        docs, sums = _tally(doc[known], np.rint(n * value * UNIT).astype(np.int64)[known])
        none = pa.nulls(len(docs), pa.int64())
        out.append(pa.Table.from_arrays([pa.array(docs), pa.array(sums), none, none, none, none], schema=_PARTS))
        return pa.concat_tables(out)

    return scored


def report(documents: DataFrame, share: float = KNOWN, frequent: int = FREQUENT, common: int = COMMON, seen: int = SEEN, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of each document."""
    if order < 2 or order > 2 and (seen > 1 or not math.isinf(share)):
        raise ValueError("the order is 2 or more; over 2 every run of words is told apart and scored by its count")
    run = order - 1
    spark = documents.sparkSession
    texts.small_batches(spark)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    only = source.select("text")
    size = only.mapInArrow(_sizes, "docs bigint, words bigint").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    counted = only.mapInArrow(_words(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    if math.isinf(share) and seen > 1:  # read twice
        counted = stored(counted.where("n > 1"))
    known = vocabulary(counted, size.words or 0, share, common)
    often = only.mapInArrow(_often(known, run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    some = often.where(F.col("n") * frequent >= (size.docs or 0)).select("gram").toPandas()
    grams = np.sort(some["gram"].to_numpy().astype(np.int64))
    counts = np.zeros(len(grams), dtype=np.int64)
    if len(grams):
        for r in only.mapInArrow(_exact(known, grams, run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():  # the rows of some
            counts[np.searchsorted(grams, r.gram)] = r.n
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * parts, (size.words or 0) // BUCKET)
    rows = source.mapInArrow(_explode(known, grams, counts, seen, buckets, run), _ROWS)
    schema = ", ".join(f"{c} bigint" for c in _PARTS.names)
    scored = rows.groupBy("bucket").applyInArrow(_scored(known.counts, known.width, known.total, seen), schema)  # a bucket has some BUCKET entries
    if known.open and seen > 1:
        # a word that has no count anywhere occurs once
        counts_ = counted.select(known.name(F.col("word")).alias("word"), F.col("n").alias("c"))
        back = F.col("times") * F.log10(F.lit(BACKOFF) * F.coalesce("c", F.lit(1)) / F.lit(max(known.total, 1)))
        asked = scored.where("word IS NOT NULL").join(counts_, "word", "left").withColumn("s", F.round(back * UNIT).cast("bigint"))
        scored = scored.where("word IS NULL").select("doc", "s", "doc_id", "n_words").unionByName(asked.select("doc", "s", "doc_id", "n_words"))
    if run > 1:
        # documents shorter than a run: their words in a row are counted at their length
        lower = [only.mapInArrow(_words(k), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("c")).withColumn("times", F.lit(k)) for k in range(1, run)]
        found = scored.where("word IS NOT NULL").join(reduce(DataFrame.unionByName, lower), ["word", "times"], "left")
        found = found.select("doc", F.round(F.log10(F.col("c") / known.total) * UNIT).cast("bigint").alias("s"), "doc_id", "n_words")
        scored = scored.where("word IS NULL").select(*found.columns).unionByName(found)
    summed = scored.groupBy("doc").agg(F.sum("s").alias("s"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    score = F.col("s").cast("double") / UNIT
    return summed.select(
        "doc_id", "n_words", rnd(score).alias("log_score"), F.when(F.col("n_words") > 0, rnd(score / F.col("n_words"))).alias("mean_log_score"),
    )


#: Distinct pairs of each document, two count tables and a sum; all pairs are counted, so none backs off.
SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ones AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM words) GROUP BY 1),
grams AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words) GROUP BY ALL),
twos AS (SELECT a, b, sum(n) AS c FROM grams GROUP BY 1, 2),
parts AS (SELECT doc_id, round(n * log10(twos.c / ones.c) * 1e9) AS part FROM grams JOIN twos USING (a, b) JOIN ones ON ones.x = a
  UNION ALL SELECT doc_id, round(log10(c / (SELECT sum(c) FROM ones)) * 1e9) FROM words JOIN ones ON x = w[1]),
summed AS (SELECT doc_id, sum(CAST(part AS BIGINT)) / 1e9 AS s FROM parts GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, floor(coalesce(s, 0) * 1000000.0 + 0.5000017) / 1000000.0 AS log_score,
  CASE WHEN len(w) > 0 THEN floor(coalesce(s, 0) / len(w) * 1000000.0 + 0.5000017) / 1000000.0 END AS mean_log_score FROM words LEFT JOIN summed USING (doc_id)
"""
