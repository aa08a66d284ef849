"""Document fingerprints from prefix polynomial hashes.

For a text with code points c, the prefix array holds H[i] = sum of (c[j] + 1) * B**j for j < i, modulo two primes near 2**31. The hash
of any span is (H[i + l] - H[i]) * B**-i, the same wherever the span stands, so two spans are equal if their hashes are, and the longest
common extension of two places is found by binary search on the length.

A fingerprint is text with four parts: the number of code points and the hash of the whole; hashes of the prefixes, and of the
suffixes, whose length is a multiple of a power of two (at most ``GRID`` of each); and the ``SKETCH`` smallest distinct hashes of
spans of ``SPAN`` code points. Two fingerprints are alike by the longer of: the common prefix and suffix, found by binary search on the grids, as a share of the
longer text; the estimated Jaccard similarity of the spans. Equal texts have equal fingerprints; likeness is 1 for equal fingerprints and
0 for an empty against another text.

The next document is the following row in descending document order (nulls last, ties by the text's hash, equal rows in any order), cyclic. Rows are cut into ranges
of ids, each range is sorted by Spark, and the first rows of the next range come along; no task holds more than two texts.

Edge cases: a null text is empty; a single document is its own next; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

GRID = 32
SPAN = 24
SKETCH = 32
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 998_244_353)
_BLOCK = 1 << 18


class _Powers:
    """Powers of a base and of its inverse modulo a prime."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.inverse, self.prime = base, pow(base, -1, prime), prime
        self.up = self.down = np.ones(1, dtype=np.uint32)

    def upto(self, n: int) -> _Powers:
        while len(self.up) < n:
            have = len(self.up)
            more = lambda table, base: np.concatenate([table, (table * np.uint64(pow(base, have, self.prime)) % np.uint64(self.prime)).astype(np.uint32)])  # noqa: B023, E731
            self.up, self.down = more(self.up, self.base), more(self.down, self.inverse)
        return self


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


class Prefix:
    """Prefix arrays of a text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            prime = np.uint64(powers.prime)
            up = powers.upto(self.n + 1).up
            out = np.zeros(self.n + 1, dtype=np.uint32)
            carry = np.uint64(0)
            for i in range(0, self.n, _BLOCK):  # the working arrays stay small
                part = (points[i : i + _BLOCK].astype(np.uint64) + np.uint64(1)) * up[i : i + len(points[i : i + _BLOCK])] % prime
                part = (np.cumsum(part) + carry) % prime
                out[i + 1 : i + 1 + len(part)] = part
                carry = part[-1]
            self.sums.append(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        halves = []
        for powers, sums in zip(_POWERS, self.sums):
            prime = np.uint64(powers.prime)
            halves.append((sums[end].astype(np.uint64) + prime - sums[start]) % prime * powers.down[start] % prime)
        return (halves[0] << np.uint64(31)) | halves[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Longest length at which the span from ``i`` equals the other text's span from ``j``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self) -> np.ndarray:
        """The smallest distinct hashes of spans, scrambled so that small ones are spread over the text."""
        best = np.zeros(0, dtype=np.uint64)
        for i in range(0, self.n - SPAN + 1, _BLOCK):
            start = np.arange(i, min(i + _BLOCK, self.n - SPAN + 1))
            h = self.spans(start, start + SPAN) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            most = 8 * SKETCH
            if len(h) > most:
                few = np.unique(np.partition(h, most)[:most])
                # a text that repeats itself may have fewer distinct ones among them
                h = few if len(few) >= SKETCH else np.unique(h)
            best = np.unique(np.concatenate([best, h]))[:SKETCH]
        return best


def _step(n: int) -> int:
    return 1 << max(0, (-(-n // GRID) - 1).bit_length()) if n > GRID else 1


def fingerprint(text: str) -> str:
    prefix = Prefix(text)
    at = np.arange(_step(prefix.n), prefix.n + 1, _step(prefix.n))
    fold = lambda h: "".join(f"{int(x) & 0xFFFFFF:06x}" for x in h)
    front = fold(prefix.spans(np.zeros(len(at), dtype=np.int64), at))
    back = fold(prefix.spans(prefix.n - at, np.full(len(at), prefix.n)))
    return f"{prefix.n:x}:{prefix.span(0, prefix.n):016x}:{front}:{back}:{''.join(f'{int(x) >> 32:08x}' for x in prefix.sketch())}"


def _common(a: str, b: str, n_a: int, n_b: int) -> int:
    """Length of the common prefix (or suffix) from two grids, by binary search."""
    step = max(_step(n_a), _step(n_b))
    at = lambda grid, n, m: grid[6 * (m * step // _step(n) - 1) :][:6]
    low, high = 0, min(n_a, n_b) // step
    while low < high:
        mid = (low + high + 1) // 2
        if at(a, n_a, mid) == at(b, n_b, mid):
            low = mid
        else:
            high = mid - 1
    return low * step


def likeness(a: str, b: str) -> float:
    """0 to 1."""
    if a == b:
        return 1.0
    (n_a, _, front_a, back_a, some_a), (n_b, _, front_b, back_b, some_b) = a.split(":"), b.split(":")
    n_a, n_b = int(n_a, 16), int(n_b, 16)
    if not n_a or not n_b:
        return 0.0
    ends = min(n_a, n_b, _common(front_a, front_b, n_a, n_b) + _common(back_a, back_b, n_a, n_b)) / max(n_a, n_b)
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (some_a, some_b))
    lowest = sorted(x | y)[:SKETCH]
    spans = sum(h in x and h in y for h in lowest) / len(lowest) if lowest else 0.0
    # not equal, so not quite 1
    return min(max(ends, spans), 1 - 1 / (1 + max(n_a, n_b)))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_REPORT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _REPORT.split(", ")]
    held = None
    for batch in batches:
        out = []
        for doc_id, text, own, bucket in zip(*(batch.column(c) for c in ("doc_id", "text", "own", "bucket"))):
            text, own, bucket = text.as_py() or "", own.as_py(), bucket.as_py()
            print_ = fingerprint(text)
            if held is not None and held[3] == bucket:
                other = edited(held[1], text)
                changed = fingerprint(other)
                out.append((held[0], len(held[1]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), held[2], changed, likeness(held[2], changed), likeness(held[2], print_)))
            held = (doc_id.as_py(), text, print_, bucket) if own else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)


def report(documents: DataFrame) -> DataFrame:
    """One row a document; see _REPORT."""
    spark = documents.sparkSession
    texts.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), rank.alias("rank"), F.col("text").cast("string").alias("text"))
    cuts = source.select("rank").agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(int(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    placed = source.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("rank"))))
    # the first row of each bucket in descending order: at most one for each partition
    top = {r.bucket: r.top for r in placed.select("rank", "bucket").groupBy("bucket").agg(F.max("rank").alias("top")).collect()}
    order = sorted(top, reverse=True)
    follow = [(top[order[(i + 1) % len(order)]], b) for i, b in enumerate(order)]
    if not follow:
        return spark.createDataFrame([], _REPORT)
    heads = F.broadcast(spark.createDataFrame(follow, "rank bigint, bucket int"))  # a row for each partition
    # of several rows with the first id, the first in order is the next document
    first = source.join(heads, "rank").groupBy("bucket", "rank").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    extra = first.select(F.lit(None).cast("bigint").alias("doc_id"), "rank", "text", "bucket", F.lit(False).alias("own"))
    rows = placed.select("doc_id", "rank", "text", "bucket", F.lit(True).alias("own")).unionByName(extra.select("doc_id", "rank", "text", "bucket", "own"))
    spread = rows.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)))
    ordered = spread.sortWithinPartitions("bucket", F.desc("own"), F.desc("rank"), F.xxhash64("text"), "text")
    return ordered.select("doc_id", "text", "own", "bucket").mapInArrow(_report, _REPORT)
