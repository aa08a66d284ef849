"""Token-ID files by bit-plane shuffling.

A file set under ``path`` has two tables. ``chunks``: blocks of ``BLOCK`` ids (the last block of a part may be
shorter), transposed into byte planes (or bit planes), each plane compressed with zstandard on its own, next to the
documents whose ids lie in the block. ``index``: for each block its part, number, first id in the whole set, ids, documents and the bytes of
its planes. Ids follow ascending document order (nulls first, then the text's hash); parts are the ranges
of one range shuffle. Spark writes both tables, so any file system will do and a lost executor leaves no half block.

A null text is empty and has the end id alone. Rows that share an id, or have none, stay rows of their own. An
empty table gives two empty tables. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import texts
from .tokens import VOCABULARY, Encoder, joined_crc32

BLOCK = 1 << 16
LEVEL = 3

CHUNK = "part int, chunk int, first bigint, n_ids int, planes array<binary>, doc_no bigint, doc_ids array<bigint>, doc_lengths array<int>, kind string"
PIECE = "part int, doc_no bigint, at bigint, doc_id bigint, n bigint, crc bigint"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first; planes of zeros above the highest used one are left out."""
    if kind == "byte":
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    else:
        planes = np.stack([np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1, bitorder="little") for b in range(32)])
    used = max((i + 1 for i, p in enumerate(planes) if p.any()), default=1)
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(p.tobytes()) for p in planes[:used]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block."""
    open_ = zstandard.ZstdDecompressor()
    out = np.zeros(n, dtype=np.uint32)
    for i, p in enumerate(planes):
        plane = np.frombuffer(open_.decompress(p), dtype=np.uint8)
        if kind == "byte":
            out |= plane.astype(np.uint32) << np.uint32(8 * i)
        else:
            out |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint32) << np.uint32(i)
    return out


class _Writer:
    """Cuts the ids of a part into blocks."""

    def __init__(self, part: int, block: int, kind: str) -> None:
        self.part, self.block, self.kind = part, block, kind
        self.chunk = self.first = 0
        self.doc_no = 0
        self.held: list[bytes] = []
        self.n = 0
        self.docs: list[tuple[int | None, int]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        at, left = 0, len(ids) // 4
        while left:
            take = min(left, self.block - self.n)
            self.held.append(ids[4 * at : 4 * (at + take)])
            self.docs.append((doc_id, take))
            self.n, at, left = self.n + take, at + take, left - take
            if self.n == self.block:
                self.flush(ended=not left)

    def flush(self, ended: bool) -> None:
        if not self.n:
            return
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        self.rows.append((self.part, self.chunk, self.first, self.n, to_planes(ids, self.kind), self.doc_no, [d for d, _ in self.docs], [n for _, n in self.docs], self.kind))
        self.doc_no += len(self.docs) - (not ended)
        self.chunk, self.first = self.chunk + 1, self.first + self.n
        self.held, self.docs, self.n = [], [], 0

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_CHUNK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_no", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())), ("kind", pa.string()),
    ]
)


def write(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 2, block: int = BLOCK, kind: str = "byte") -> None:
    """Encode every text, append ``end_id`` to each document, and write the file set below ``path``."""
    spark = documents.sparkSession
    texts.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, end = Encoder.of(vocabulary), _Writer(TaskContext.get().partitionId(), block, kind), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in texts.parts(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    writer.add(doc_id, ids + end)
                if writer.rows:
                    yield writer.take(_CHUNK_ARROW)
        writer.flush(ended=True)
        yield writer.take(_CHUNK_ARROW)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(chunks, CHUNK).write.option("compression", "none").parquet(f"{path}/chunks")
    written = spark.read.parquet(f"{path}/chunks")
    sizes = {r.part: r.n for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row a part
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))  # one row a part
    index = written.join(starts, "part").select(
        "part", "chunk", (F.col("first") + F.col("before")).alias("start"), "n_ids", F.size("doc_ids").alias("n_docs"), F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes"), "kind"
    )
    index.write.parquet(f"{path}/index")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            raw = from_planes(r["planes"], r["n_ids"], r["kind"]).astype("<u4").tobytes()
            at = 0
            for k, (doc_id, n) in enumerate(zip(r["doc_ids"], r["doc_lengths"])):
                out.append((r["part"], r["doc_no"] + k, r["first"] + at, doc_id, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, [pa.int32(), *[pa.int64()] * 5])], ["part", "doc_no", "at", "doc_id", "n", "crc"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [joined_crc32([(4 * p["n"], p["crc"]) for p in sorted(x, key=lambda p: p["at"])]) for x in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a file set, from its decoded blocks: doc_id, start, n_tokens, ids_crc32."""
    chunks, index = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/index")
    starts = F.broadcast(index.groupBy("part").agg(F.min("start").alias("before")))  # one row a part
    pieces = chunks.select("part", "first", "n_ids", "planes", "doc_no", "doc_ids", "doc_lengths", "kind").mapInArrow(_pieces, PIECE)
    whole = pieces.groupBy("part", "doc_no").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("at", "n", "crc")).alias("pieces")
    )  # a document has one piece for each block it touches
    return whole.join(starts, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "pieces").mapInArrow(_joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file set as id arrays: part, chunk, first, ids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [from_planes(r["planes"], r["n_ids"], r["kind"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("part", "chunk", "first")], pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["part", "chunk", "first", "ids"]
            )

    return spark.read.parquet(f"{path}/chunks").select("part", "chunk", "first", "n_ids", "planes", "kind").mapInArrow(blocks, "part int, chunk int, first bigint, ids array<bigint>")
