"""Exact removal of word runs that occur earlier: De Bruijn compaction of repeated token k-mers.

Edges are the k-mers of ``WINDOW`` words. An edge belongs to the node named by its smallest inner ``INNER``-mer (a
minimiser, so that equal edges have equal nodes). Successive edges of one node form a piece of a path, which is what travels:
one row a piece instead of one a word, with a hash of its path and not the path itself.

* A piece that occurs twice in one task is already known to repeat: only its earliest copy goes on.
* Pieces are shuffled once, by node. A node with one piece, no edge of it twice, ends there. A node whose pieces all
  have the same edges, none of them twice, does not branch: its path is compacted to one row, and all but its earliest copy are repeats. Only the
  pieces of branching nodes go back to their documents, where they are opened into edges, and each edge's earliest copy is looked up.
* The source coordinates (document, first word, words) of the repeats are joined back to the documents, where the
  covered words go. Both joins with the documents read one shuffle of them.

An edge is identified by the 64 bits of its own hash within its node: n different edges of one node give about n * n / 2**65 false equals
(8 million: 2 in a million).

Order: document id (nulls first), then the text's hash, then the word. Edge cases: a null or empty text has no words; texts under 20
words keep all; rows equal in id and text are one document and get the same result; rows that share an id alone are documents of
their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import texts

WINDOW = 20
INNER = 6
#: Edges in a piece.
PIECE = 64
#: Pieces a task remembers; beyond it only fewer copies are found before the shuffle.
MEMORY = 1 << 20

#: A piece travels as few bytes as it can: ``place`` holds the tag (23 bits), the first word (31), the number of edges (7), and whether the
#: piece repeats an earlier one of its task and whether an edge is in it twice (1 each), so that places of a document ascend. ``path`` is the hash
#: of its edges, null for a repeat.
_PIECES = "node bigint, doc_id bigint, place bigint, path bigint"
_EDGES = "doc_id bigint, tag int, node bigint, edge bigint, start int"


class _Seen:
    """The earliest place of each piece that a task has met."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros((0, 2), dtype=np.int64)

    def repeats(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pieces have an earlier equal one; the others are remembered."""
        if len(self.key) > MEMORY:
            self.clear()
        n = len(self.key)
        key, place = np.concatenate([self.key, key]), np.concatenate([self.place, place])
        order = np.lexsort((place[:, 1], place[:, 0], key))
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[order][1:] != key[order][:-1]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        out = np.empty(len(key), dtype=bool)
        out[order] = (place[order] != place[order[lead]]).any(axis=1)  # the same place twice: a row that is there twice
        self.key, self.place = key[order[first]], place[order[first]]
        return out[n:]


def pieces(batches: Iterator[pa.RecordBatch], window: int = WINDOW, inner: int = INNER) -> Iterator[pa.RecordBatch]:
    """Rows of _PIECES from rows of doc_id, tag and text."""
    seen = _Seen()
    for batch in batches:
        for part in texts.parts(batch):
            w = texts.words(part.column("text"))
            if len(w.hashes) < window:
                continue
            edge = texts.windows(w.hashes, window)
            at = np.flatnonzero(w.left()[: len(edge)] >= window)
            if not len(at):
                continue
            edge, node = edge[at], texts.sliding_min(texts.windows(w.hashes, inner), window - inner + 1)[at]
            cut = np.ones(len(at), dtype=bool)
            cut[1:] = (at[1:] != at[:-1] + 1) | (node[1:] != node[:-1])
            run = np.flatnonzero(cut)
            cut |= (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % PIECE == 0
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(at))
            owner = np.searchsorted(w.first, at[first], side="right") - 1
            start = at[first] - w.first[owner]
            doc, tag = part.column("doc_id").take(pa.array(owner)), part.column("tag").take(pa.array(owner))
            place = (tag.to_numpy().astype(np.int64) << 40) | (start << 9)
            path = texts.span_hashes(edge, first, last)
            again = seen.repeats(path, np.stack([doc.fill_null(-(2**63)).to_numpy(), place], axis=1))
            # half of an edge is enough here: a piece that only seems to have an edge twice is opened, and its whole edges are compared
            inside = np.sort((np.repeat(np.arange(len(first), dtype=np.uint64), last - first) << np.uint64(32)) | (edge >> np.uint64(32)))
            loops = np.zeros(len(first), dtype=bool)
            loops[(inside[1:][inside[1:] == inside[:-1]] >> np.uint64(32)).astype(np.int64)] = True
            place |= ((last - first) << 2) | (again.astype(np.int64) << 1) | loops
            yield pa.RecordBatch.from_arrays([pa.array(node[first].view(np.int64)), doc, pa.array(place), pa.array(path.view(np.int64), mask=again)], ["node", "doc_id", "place", "path"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _EDGES: each edge of the pieces listed with a document."""
    for batch in batches:
        for part in texts.parts(batch):
            w = texts.words(part.column("text"))
            edge = texts.windows(w.hashes, WINDOW)
            listed = part.column("pieces")
            doc = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
            start, edges, node = (c.to_numpy() for c in listed.flatten().flatten())
            fits = start + edges + WINDOW - 1 <= np.diff(w.first)[doc]  # an id and tag may have other texts too
            doc, start, edges, node = doc[fits], start[fits].astype(np.int64), edges[fits], node[fits]
            piece = np.repeat(np.arange(len(doc)), edges)
            start = start[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(edges) - edges, edges)
            doc = doc[piece]
            found = pa.array(edge[w.first[doc] + start].view(np.int64))
            doc_id, tag = part.column("doc_id").take(pa.array(doc)), part.column("tag").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([doc_id, tag, pa.array(node[piece]), found, pa.array(start.astype(np.int32))], ["doc_id", "tag", "node", "edge", "start"])


def _with(documents: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """The documents (doc_id, tag, text) with the column ``name`` of a table of doc_id and tag."""
    lists = lists.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), name)
    return documents.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), how).select("doc_id", "tag", "text", name)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, tag and spans: for each document with words to remove, the (first word, words) that occur earlier."""
    texts.small_batches(documents.sparkSession)
    node = Window.partitionBy("node")
    bits = lambda at, n: F.shiftright("place", at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    repeats, loops = bits(1, 1) == 1, bits(0, 1) == 1
    copy = F.struct("doc_id", "place")
    found = documents.mapInArrow(pieces, _PIECES).select(
        "*", F.count(F.lit(1)).over(node).alias("n"), F.min("path").over(node).alias("low"), F.max("path").over(node).alias("high"),
        F.min(F.when(~repeats, copy)).over(node).alias("earliest"), F.max(loops).over(node).alias("looped"),
    ).where("n > 1 OR looped")
    branches = ~repeats & ((F.col("low") != F.col("high")) | F.col("looped"))
    first_copy = ~repeats & ~branches & F.col("earliest").eqNullSafe(copy)
    # read twice
    found = stored(found.where(~first_copy).select("node", "doc_id", bits(40, 23).alias("tag"), bits(9, 31).alias("start"), bits(2, 7).alias("edges"), branches.alias("branches")))
    lists = found.where("branches").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "edges", "node")).alias("pieces"))  # bounded by the document's length
    edges = _with(documents, lists, "pieces", "inner").mapInArrow(_opened, _EDGES)
    first = Window.partitionBy("node", "edge").orderBy("doc_id", "tag", "start")
    again = edges.withColumn("k", F.rank().over(first)).where("k > 1").select("doc_id", "tag", "start", F.lit(WINDOW).alias("words"))
    again = again.unionByName(found.where("NOT branches").select("doc_id", "tag", "start", (F.col("edges") + WINDOW - 1).alias("words")))
    return again.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "words")).alias("spans"))  # bounded by the document's length


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in texts.parts(batch):
            n_words, removed, digests = [], [], []
            data, offsets = texts.utf8(part.column("text"))
            raw = data.tobytes()
            spans = part.column("spans")
            for d in range(part.num_rows):
                words = raw[offsets[d] : offsets[d + 1]].split()
                n_words.append(len(words))
                if spans[d].is_valid:
                    pairs = spans[d].values.flatten()
                    start, size = pairs[0].to_numpy(), pairs[1].to_numpy()
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + size, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    removed.append(0)
                digests.append((b" ".join(words)).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _source(documents: DataFrame) -> DataFrame:
    # the join of `deduplicated` looks a document up by its id and the tag
    text = F.col("text").cast("string")
    tag = F.coalesce(F.pmod(F.hash(text), F.lit(1 << 23)), F.lit(0))  # never null, and Spark can tell
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), tag.alias("tag"), text.alias("text"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    docs = _source(documents)
    return _with(docs, repeated_spans(docs), "spans", "left").drop("tag").mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def report(documents: DataFrame) -> DataFrame:
    return deduplicated(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM again),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id),
count AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN count USING (doc_id)
"""
