"""Interaction of five filters over a corpus, kept up to date by a stream with retractions.

The files of the documents arrive as micro-batches of one available-now stream. A task sets the bits of the filters that a text
fails on its own (A to D) and a 128-bit digest of the text; labels are joined to these narrow rows. Filter E (some document with a
smaller id has the same text) depends on what has come so far: a keyed state holds, for each distinct text, its smallest id and what that
document counts as; texts share a key by their digest, about ``TEXTS`` to a key, as each key costs a call. When a smaller id
arrives, the earlier document's count is taken back and counted again as failing E. The changes of a micro-batch are summed by part and failed filters and written to that batch's own folder, so a repeated batch replaces itself.
Since each document ends with one set of failed filters, those counts (at most 32 sets a part and label) give every order of the filters.

Copies of one text may be any share of the rows: before the shuffle a task keeps only the smallest id of each text among its rows and
sums up the rest, which fail E whatever else comes. State lies in the state store of the session, below the checkpoint
location; set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider for corpora whose digests exceed the executors' heap.

Defined results: a null text is empty, a null lang the part ''. Rows with one id and one text do not make each other fail E; rows without an
id neither fail it nor make others fail. Of several labels of an id the largest counts. Further columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch
from .texts import SPACES, Words, parts, small_batches, utf8

FILTERS = "ABCDE"
#: Fixed limits of the filters: fewest words, least share of distinct words, most share of capitals (percent), marks that a text must not hold.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, "#$%&*|"
#: Micro-batches that the files are dealt over.
BATCHES = 4
E_BIT = 16
COUNTERS = "part string, mask int, quality boolean, toxic boolean, n bigint"
#: Distinct texts that share a key of the state, at most about.
TEXTS = 1000
_NARROW = "doc_id bigint, part string, mask int, a bigint, b bigint"
_COMBINED = "bucket bigint, a bigint, b bigint, doc_id bigint, part string, code int, n bigint"
_FIELDS = ["a", "b", "doc_id", "part", "code"]


def failed_alone(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D (1, 2, 4, 8) that each text fails."""
    data, offsets = utf8(column)
    words = Words(data, offsets, SPACES, False)
    n, owner = np.diff(words.first), words.owners()
    order = np.lexsort((words.hashes, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(words.hashes[order]) != 0) | (np.diff(owner[order]) != 0)
    distinct = np.bincount(owner[order][new], minlength=len(n))

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    marks = np.zeros(256, dtype=bool)
    marks[list(MARKS.encode())] = True
    points = count((data & 0xC0) != 0x80)
    bits = [n < WORDS, 100 * distinct < DISTINCT * n, 100 * count((data >= 65) & (data <= 90)) > CAPITALS * points, count(marks[data]) > 0]
    return sum(b.astype(np.int32) << i for i, b in enumerate(bits))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            data, offsets = utf8(part.column("text"))
            body = memoryview(np.ascontiguousarray(data))
            keys = b"".join(hashlib.blake2b(body[i:j], digest_size=16).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            a, b = np.frombuffer(keys, dtype="<i8").reshape(-1, 2).T
            columns = [part.column("doc_id"), part.column("part"), pa.array(failed_alone(part.column("text")), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "a", "b"])


def _firsts(rows: pd.DataFrame) -> np.ndarray:
    """For each row the smallest id of its text."""
    order = np.lexsort((rows["doc_id"].to_numpy(), rows["b"].to_numpy(), rows["a"].to_numpy()))
    a, b = rows["a"].to_numpy()[order], rows["b"].to_numpy()[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = rows["doc_id"].to_numpy()[order][new][np.cumsum(new) - 1]
    return out


def _combined(buckets: int):
    """Rows that may still be a text's first go on under its key; the others as sums under a key of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = -1 - TaskContext.get().partitionId()
        for batch in batches:
            rows = batch.to_pandas()
            known = rows[rows["doc_id"].notna()].astype({"doc_id": "int64"})
            fails = known["doc_id"].to_numpy() > _firsts(known)
            later = known[fails].assign(code=known["code"][fails] | E_BIT)
            sums = pd.concat([rows[rows["doc_id"].isna()], later]).groupby(["part", "code"], as_index=False).size().rename(columns={"size": "n"})
            first = known[~fails].groupby(_FIELDS, as_index=False, sort=False).size().rename(columns={"size": "n"})
            first["bucket"] = first["a"] % buckets
            out = pd.concat([first, sums.assign(bucket=own, a=0, b=0, doc_id=0)])
            yield pa.RecordBatch.from_pandas(out[["bucket", *_FIELDS, "n"]].astype({"code": "int32", "n": "int64", "bucket": "int64"}), preserve_index=False)

    return run


def _changes(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count changes that new rows of a key's texts make."""
    new = pd.concat(list(chunks))[[*_FIELDS, "n"]]
    if key[0] < 0:
        yield new[["part", "code", "n"]]
        return
    old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0]
    rows = pd.concat([old, new], ignore_index=True)
    was, fails = np.arange(len(rows)) < len(old), rows["doc_id"].to_numpy() > _firsts(rows)
    back = rows[was & fails]  # no longer the first of their text
    moved = [back.assign(n=-back["n"]), back.assign(code=back["code"] | E_BIT)]
    come = rows[~was].assign(code=rows["code"].where(~fails, rows["code"] | E_BIT)[~was])
    changes = pd.concat([*moved, come]).groupby(["part", "code"], as_index=False)["n"].sum()
    first = rows[~fails].groupby(_FIELDS, as_index=False, sort=False)["n"].sum()
    table, sink = pa.Table.from_pandas(first, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield changes[changes["n"] != 0].astype({"code": "int32", "n": "int64"})


def changes(documents: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """The stream of count changes (part, code, n) of a stream of documents; the code holds failed filters and two label bits."""
    small_batches(documents.sparkSession)
    narrow = documents.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(_narrow, _NARROW)
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_at"), F.lit(True).alias("_has"))
    known = known.agg((flag("quality") * 32 + flag("toxic") * 64).alias("_bits"))
    # Rows without an id have no label: they are spread by their text.
    at, has = F.coalesce("doc_id", F.xxhash64("a", "mask")), F.col("doc_id").isNotNull()
    labelled = narrow.withColumn("_at", at).withColumn("_has", has).join(known, ["_at", "_has"], "left")
    code = (F.col("mask") + F.coalesce("_bits", F.lit(0))).cast("int").alias("code")
    combined = labelled.select("a", "b", "doc_id", "part", code).mapInArrow(_combined(buckets), _COMBINED)
    return combined.groupBy("bucket").applyInPandasWithState(_changes, "part string, code int, n bigint", "firsts binary", "append", GroupStateTimeout.NoTimeout)


def counted(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents by part, failed filters and labels, after all files below ``path`` (Parquet) have gone through the stream."""
    table = spark.read.parquet(path)
    buckets = 1 + max(table.count() // TEXTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = max(1, -(-len(table.inputFiles()) // batches))
    folder = scratch(spark, "audit")
    kind = "part string, code int, n bigint"
    spark.createDataFrame([], kind).write.parquet(f"{folder}/counters/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    path = path.rstrip("/")
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern: a stream takes a single file only so
    stream = changes(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(either), labels, buckets)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.schema(kind).parquet(f"{folder}/counters").groupBy("part", "code").agg(F.sum("n").alias("n")).filter("n > 0")
    code = F.col("code")
    return sums.select("part", code.bitwiseAND(31).alias("mask"), (code.bitwiseAND(32) > 0).alias("quality"), (code.bitwiseAND(64) > 0).alias("toxic"), "n")


def interactions(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from counts of documents by failed filters (bit i: filter i)."""
    plans = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            plans.append(("".join(filters[j] for j in order), step, 1 << i, before))
            before |= 1 << i
    steps = counters.sparkSession.createDataFrame(plans, "filter_order string, step int, bit int, before int")
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("n")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    total = lambda hit, value=n: F.coalesce(F.sum(F.when(hit, value)), F.lit(0)).cast("long")
    # Over all orders each filter that a document fails comes first equally often.
    orders = F.element_at(F.array(*[F.lit(len(plans) // len(filters) // k) for k in range(1, len(filters) + 1)]), F.greatest(F.bit_count(mask), F.lit(1)).cast("int"))
    return counters.crossJoin(F.broadcast(steps)).groupBy("part", "filter_order", "step").agg(  # orders and steps are fixed
        total(mask.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("quality")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
        total(fails, n * orders).alias("shapley"),
    )


def report(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    return interactions(counted(spark, path, labels, batches))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
known AS (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM cut LEFT JOIN known USING (doc_id)),
counters AS (SELECT part, mask, quality, toxic, count(*) AS n FROM marked GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) s(step)),
one AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND quality = 1), 0) AS good_lost,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND toxic = 1), 0) AS toxic_lost FROM counters, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM one"""
