"""Benchmark decontamination: a prefix-filtered containment join between documents and benchmark windows.

A window is a run of 13 item words (an item with fewer words, but not none, is one window). A document contains a
window only if it contains all of the window's shingles, so one necessary shingle a window is enough to find every
occurrence: the prefix of length |W| - ceil(1.0 |W|) + 1 = 1 in the order of rarity. The steps:

1. count the benchmark's shingles (three words, or the whole of a shorter window) over all documents;
2. file each distinct window under its rarest shingle;
3. look every document shingle up among those; the shingle's place in the window says where the window must start,
   which must lie in the document and leave room for its length;
4. compare the item-sized run of words.

The benchmark is a stated query set: it is taken in blocks of ``BLOCK_BYTES`` bytes of text, and each block is held
against all documents. Documents are never shuffled.

Edge cases: a null or empty text has no words; an item without text, words or id is left out; several rows of one
item id count as one item; repeated document rows and null ids are kept as they are; extra columns can be carried, and the
report's own columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

WINDOW = 13
SHINGLE = 3
#: Benchmark text held by a task at a time.
BLOCK_BYTES = 16 << 20
#: Candidate windows compared at a time.
STEP = 1 << 18

_STATE = "_spans array<int>, _items array<bigint>"


@dataclass
class Block:
    """Distinct windows of some items: word hashes one after the other, and the items each window occurs in."""

    words: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    items: np.ndarray
    items_first: np.ndarray

    @staticmethod
    def of(ids: list[int], item_texts: list[str]) -> Block:
        w = texts.words(pa.array(item_texts, pa.string()), texts.SYMBOLS, lower=True)
        counts = np.diff(w.first)
        size = np.minimum(counts, WINDOW)
        n = np.where(counts > 0, counts - size + 1, 0)
        owner = np.repeat(np.arange(len(counts)), n)
        begin = w.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        length = size[owner]
        key = texts.span_hashes(w.hashes, begin, begin + length) if len(begin) else np.zeros(0, dtype=np.uint64)
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        pair = np.unique(np.stack([back, np.array(ids, dtype=np.int64)[owner]], axis=1), axis=0) if len(owner) else np.zeros((0, 2), dtype=np.int64)
        return Block(w.hashes, begin[where], length[where], pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(where) + 1)))

    def sizes(self) -> list[int]:
        return sorted({int(x) for x in np.minimum(self.length, SHINGLE)})

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, place in the window, and hash of each shingle of each window."""
        per = self.length - np.minimum(self.length, SHINGLE) + 1
        window = np.repeat(np.arange(len(per)), per)
        place = np.arange(len(window)) - np.repeat(np.cumsum(per) - per, per)
        at = self.begin[window] + place
        size = np.minimum(self.length, SHINGLE)[window]
        out = np.zeros(len(window), dtype=np.uint64)
        for k in self.sizes():
            own = size == k
            order = np.argsort(at[own], kind="stable")
            h = np.empty(own.sum(), dtype=np.uint64)
            h[order] = texts.span_hashes(self.words, at[own][order], at[own][order] + k)
            out[own] = h
        return window, place, out


class Lookup:
    """Positions of some 64-bit values in a sorted array; a bit table turns most strangers away."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``values``, positions in ``known``) of the values that are known."""
        at = np.flatnonzero(self.seen[(values >> np.uint64(44)).astype(np.int64)])
        if not len(self.known):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
        same = self.known[place] == values[at]
        return at[same], place[same]


def _document_shingles(w: texts.Words, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and hash of each shingle that lies in one document."""
    left = w.left()
    for k in sizes:
        h = texts.windows(w.hashes, k)
        at = np.flatnonzero(left[: len(h)] >= k)
        yield at, h[at]


def shingle_counts(documents: DataFrame, block: Block) -> np.ndarray:
    """Occurrences over all documents of each distinct shingle of the block, in the order of their hashes."""
    known = np.unique(block.shingles()[2])
    sizes = block.sizes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(known), np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in texts.parts(batch):
                w = texts.words(part.column(0), texts.SYMBOLS, lower=True)
                for _, h in _document_shingles(w, sizes):
                    total += np.bincount(lookup.find(h)[1], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["shingle", "n"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    out = np.zeros(len(known), dtype=np.int64)
    for row in counted.toLocalIterator():  # at most one row for each shingle of the block
        out[row.shingle] = row.n
    return out


class Matcher:
    """Finds every occurrence of a block's windows in documents."""

    def __init__(self, block: Block, counts: np.ndarray) -> None:
        self.block = block
        window, place, h = block.shingles()
        known, which = np.unique(h, return_inverse=True)
        # the rarest shingle of each window: by count, then hash, then place
        order = np.lexsort((place, which, counts[which], window))
        first = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
        by = first[np.argsort(which[first], kind="stable")]
        self.anchors, start = np.unique(known[which[by]], return_index=True)
        self.anchor_first = np.append(start, len(by))
        self.anchor_window, self.anchor_place = window[by], place[by]
        self.lookup = Lookup(self.anchors)

    def occurrences(self, w: texts.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence; the word index runs over all documents of ``w``."""
        begin = np.repeat(w.first[:-1], np.diff(w.first))
        finish = np.repeat(w.first[1:], np.diff(w.first))
        starts, found = [], []
        for at, h in _document_shingles(w, self.block.sizes()):
            hit, anchor = self.lookup.find(h)
            at = at[hit]
            n = self.anchor_first[anchor + 1] - self.anchor_first[anchor]
            edges = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + STEP, STEP), side="right")
            for i, j in zip(edges[:-1], edges[1:]):
                i, j = int(i), int(j)
                pick = np.repeat(np.arange(i, j), n[i:j])
                entry = self.anchor_first[anchor[pick]] + np.arange(len(pick)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
                window = self.anchor_window[entry]
                start = at[pick] - self.anchor_place[entry]
                size = self.block.length[window]
                fits = (start >= begin[at[pick]]) & (start + size <= finish[at[pick]])
                start, window, size = start[fits], window[fits], size[fits]
                for k in range(int(size.max(initial=0))):
                    if not len(start):
                        break
                    short = k >= size
                    same = short | (w.hashes[np.where(short, start, start + k)] == self.block.words[self.block.begin[window] + np.where(short, 0, k)])
                    start, window, size = start[same], window[same], size[same]
                starts.append(start)
                found.append(window)
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(starts), np.concatenate(found)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of the runs [start, end) as flat pairs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
    return np.stack([start[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)]], axis=1).ravel()


def _match(matcher: Matcher):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.parts(batch, "_text"):
                w = texts.words(part.column("_text"), texts.SYMBOLS, lower=True)
                spans, items = part.column("_spans").to_pylist(), part.column("_items").to_pylist()
                start, window = matcher.occurrences(w)
                owner = np.searchsorted(w.first, start, side="right") - 1
                order = np.argsort(owner, kind="stable")
                start, window, owner = start[order], window[order], owner[order]
                block = matcher.block
                for d in np.unique(owner):
                    i, j = np.searchsorted(owner, [d, d + 1])
                    own = start[i:j] - w.first[d]
                    both = np.array(spans[d], dtype=np.int64).reshape(-1, 2)
                    spans[d] = _merged(np.append(both[:, 0], own), np.append(both[:, 1], own + block.length[window[i:j]])).tolist()
                    seen = [block.items[block.items_first[x] : block.items_first[x + 1]] for x in np.unique(window[i:j])]
                    items[d] = np.unique(np.concatenate([np.array(items[d], dtype=np.int64), *seen])).tolist()
                columns = [part.column(c) for c in part.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], part.schema.names)

    return match


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in texts.parts(batch, "_text"):
            w = texts.words(part.column("_text"), texts.SYMBOLS, lower=True)
            n = np.diff(w.first)
            spans, items = part.column("_spans").to_pylist(), part.column("_items").to_pylist()
            hit = np.array([sum(s[1::2]) - sum(s[::2]) for s in spans], dtype=np.int64)
            digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            keep = [part.column(c) for c in part.schema.names if c not in ("_text", "_spans", "_items")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(n, pa.int64()), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array((hit > 0) & (20 * hit >= n))],
                [*[c for c in part.schema.names if c not in ("_text", "_spans", "_items")], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes`` bytes of text; an item lies in one block."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # bounded: one block
        yield Block.of([r.item_id for r in rows], [r.text for r in rows])


def report(documents: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of each document with n_words, n_hit, n_items, items_sha256 and contaminated
    (at least one word in twenty, and one, lies in an occurrence of a window)."""
    texts.small_batches(documents.sparkSession)
    own = [c.split()[0] for c in REPORT.split(", ")]
    keep = [c for c in keep if c not in own]
    df = documents.select(
        *[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"), F.expr("cast(array() as array<int>)").alias("_spans"), F.expr("cast(array() as array<bigint>)").alias("_items")
    )
    for block in blocks(benchmark, block_bytes):
        if len(block.begin):
            df = df.mapInArrow(_match(Matcher(block, shingle_counts(documents, block))), df.schema)
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + [REPORT])
    return df.mapInArrow(_report, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = documents.columns
    hidden = documents.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)] + [F.col("text")])
    kept = report(hidden, benchmark, [f"c{i}" for i in range(len(names))]).where("NOT contaminated")
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS size FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
runs AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
hits AS (SELECT r.doc_id, r.i, r.size, w.item_id FROM runs r JOIN wins w USING (size, win)),
marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
