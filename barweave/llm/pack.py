"""Harmonic packing of token sequences.

The capacity C is split into the classes (C/(k+1), C/k]; a piece in class k fits k times into a sequence. Full
sequences are cut off each document first. Of what is left, the largest unit fraction C/k is cut off as long as
bins of the uncut rest would lose more than ``SLACK`` of C, so that nearly every piece is a whole C/k and its bins come out
full. Each task fills the bins of each class with exactly k pieces, without knowing of any other task. The
open bins of the tasks (fewer than k pieces a class and task) are filled again by 64 tasks' worth at a time, until one group
is left, whose size depends on C alone; its open bins are packed by best fit.

A null text is empty and is one piece with the end id. Repeated rows and null ids are documents of their own. An empty
table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import texts
from .tokens import VOCABULARY, Encoder

CAPACITY = 2048
#: Share of the capacity that bins of one class may lose before a rest is cut again.
SLACK = 0.01
#: Rests of this share of the capacity are not cut again.
TAIL = 1 / 24
COHORT = 64

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_ARROW = pa.schema([(c, pa.int64()) for c in [*_NAMES, "task"]])


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        uncut = capacity - (capacity // rest) * rest
        if uncut <= SLACK * capacity or rest <= TAIL * capacity:
            out.append(rest)
            break
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out


class Bins:
    """The open bin of each class; a full bin gets the next sequence id."""

    def __init__(self, capacity: int, next_id: int) -> None:
        self.capacity, self.next_id = capacity, next_id
        self.open: dict[int, list[list]] = {}

    def add(self, piece: list) -> list[list]:
        """Returns the pieces of the bin that this piece completes."""
        k = self.capacity // piece[2]
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) < k:
            return []
        del self.open[k]
        return self.close(own)

    def close(self, own: list[list]) -> list[list]:
        offset = 0
        for p in own:
            p[5], p[6] = self.next_id, offset
            offset += p[2]
        self.next_id += 1
        return own

    def rest(self) -> list[list]:
        return [p for own in self.open.values() for p in own]

    def best_fit(self) -> list[list]:
        """Closes the open bins together: longest piece first, into the fullest sequence that takes it."""
        room: list[list[list]] = [[] for _ in range(self.capacity + 1)]
        for p in sorted(self.rest(), key=lambda p: (-p[2], str(p[:2]))):
            at = next((r for r in range(p[2], self.capacity + 1) if room[r]), None)
            own = room[at].pop() if at is not None else []
            own.append(p)
            room[(at if at is not None else self.capacity) - p[2]].append(own)
        return [p for bins in room for own in bins for p in self.close(own)]


def _again(capacity: int, level: int, last: bool):
    def again(pieces: pd.DataFrame) -> pd.DataFrame:
        task = int(pieces["task"].iloc[0])
        bins = Bins(capacity, (level << 56) + ((task + 1) << 32))
        pieces = pieces.sort_values(["_from", "start", "length", "doc_id", "ids_crc32"])
        rows = [[None if pd.isna(x) else int(x) for x in p] for p in pieces[_NAMES].astype(object).to_numpy()]
        out = [p for r in rows for p in bins.add(r)]
        out += bins.best_fit() if last else bins.rest()
        return pd.DataFrame(out, columns=_NAMES).astype("Int64").assign(task=task)

    return again


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every document as token ids with ``end_id`` behind, cut into pieces and placed: one row a piece."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, end, bins = Encoder.of(vocabulary), np.array([end_id], dtype="<u4").tobytes(), Bins(capacity, (task + 1) << 32)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*zip(*rows), [task] * len(rows))] if rows else [pa.array([], pa.int64())] * 8, schema=_ARROW)
        for batch in batches:
            for part in texts.parts(batch):
                full: list[list] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for length in cuts(n, capacity):
                        full += bins.add([doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, None, None])
                        at += length
                yield table(full)
        yield table(bins.rest())

    texts.small_batches(documents.sparkSession)
    df = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = stored(df.mapInArrow(first, f"{PIECE}, task bigint"))
    done, left = packed.where("sequence_id IS NOT NULL").drop("task"), packed.where("sequence_id IS NULL")
    most = packed.agg(F.max("task")).first()[0]
    level, tasks = 1, (most or 0) + 1
    while True:
        tasks = -(-tasks // COHORT)
        last = tasks == 1

        # a group has fewer than k pieces of each class from each of COHORT tasks
        cohort = left.withColumn("_from", F.col("task")).withColumn("task", F.floor(F.col("task") / COHORT))
        filled = stored(cohort.groupBy("task").applyInPandas(_again(capacity, level, last), f"{PIECE}, task bigint"))
        done = done.unionByName(filled.where("sequence_id IS NOT NULL").drop("task"))
        if last:
            return done
        left, level = filled.where("sequence_id IS NULL"), level + 1
