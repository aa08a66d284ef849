"""Near-duplicate classes: an exact Jaccard join of word-shingle sets over an R-tree of count vectors.

A document's set holds its distinct 5-word shingles. The shingles are hashed into groups (``GROUPS``, or more for long texts), and the counts of the groups
are the document's point. For two sets the sum of the coordinate minima bounds the overlap from above, so a pair can be
dropped, or a pair of boxes with all their pairs, if that sum is under the overlap that the similarity asks for.

1. Equal sets become one node (its copies are only attached again at the end).
2. The root of the tree fans out by shingle: two sets that are similar enough share one of their first
   n - ceil(0.8 n) + 1 shingles in any common order. The order is by hash, but shingles found to be frequent, or only shared by many different
   sets, come last, the most common at the very end, so that neither passages nor chance phrases gather unlike documents in groups that grow with the table. A fan-out group needs two nodes; groups with equal members are searched once.
3. Star round: each member is held against one member of its group. Point bound first, then the sets. Dense groups of
   near copies become one component here, with as many pairs as members.
4. Search: in each group that still has more than one component, the points, folded to ``GROUPS`` coordinates, are packed into leaves by recursive halving on
   the widest coordinate, after a cut by size; boxes of leaves whose sizes are close enough, then points, then long texts' points with all their coordinates, are bounded by their summed minima; pairs between components that survive are
   verified on the sets. Groups over ``TILE`` members are searched as pairs of tiles, so a task's memory stays bounded. One group in
   ``FIRST_GROUPS`` is searched first, all others after its links have joined components: no group is left out.
5. Links become components by alternating large-star and small-star steps; component ids are the smallest document ids.

Which shingles count as frequent or shared is taken from all documents, but only changes how work is spread; the result is exact.

Edge cases: a null or empty text, or one of separators only, has no shingles and is its own component; fewer than 5 words are one
shingle; rows that share an id are documents of their own; a null id never is a component id unless the whole component has none; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import texts
from .decontaminate import Lookup

SHINGLE = 5
GROUPS = 256
LEAF = 16
#: Bytes of text taken at a time.
RUN = 1 << 21
#: Nodes that a task remembers, and pairs that it holds before it hands them on.
RECENT = 1 << 18
HELD = 1 << 19
SMALL = 48
#: Earlier groups that a group's pairs are held against.
MARKS = 1 << 13
TILE = 4096
#: One group in so many is searched before the others.
FIRST_GROUPS = 16
#: A shingle found in one document of so many goes last in the order: at most so many times the shingles of an average document do.
FREQUENT = 256
#: So does a shingle shared by one set of so many, and by ``LEAST`` sets at least, if its hash is under ``LOW``: the fan-out takes the lowest hashes, some fifth of a set.
SHARED = 1 << 14
LEAST = 16
LOW = 3 << 61
#: Low hashes that a task holds before it counts them.
TALLY = 1 << 21
#: Nodes whose ids are sent to every task; beyond that the ids are joined instead.
SENT = 1 << 20


class Sets:
    """Shingle sets of some texts: document d owns ``values[first[d]:first[d + 1]]``, ascending."""

    def __init__(self, column: pa.Array) -> None:
        w = texts.words(column, lower=True)
        grams = texts.windows(w.hashes, SHINGLE)
        own, empty = [], np.zeros(0, dtype=np.uint64)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if j - i >= SHINGLE:
                s = np.sort(grams[i : j - SHINGLE + 1])
                own.append(s[np.append(True, s[1:] != s[:-1])])
            elif j > i:
                own.append(texts.span_hashes(w.hashes[i:j], np.array([0]), np.array([j - i])))
            else:
                own.append(empty)
        self.sizes = np.array([len(s) for s in own])
        self.first = np.append(0, np.cumsum(self.sizes))
        self.values = np.concatenate(own) if own else empty
        self.owner = np.repeat(np.arange(len(own)), self.sizes)
        #: one 64-bit name for each set
        self.names = texts.span_hashes(self.values, self.first[:-1], self.first[1:]).view(np.int64)

    def points(self) -> list[bytes]:
        """The count vector of each set, with a byte in front that tells its item size."""
        groups = dimensions(self.sizes)
        base = np.append(0, np.cumsum(groups))
        cell = base[self.owner] + (self.values & (groups[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        counts = np.bincount(cell, minlength=int(base[-1]))
        out = []
        for i, j in zip(base[:-1].tolist(), base[1:].tolist()):
            own = counts[i:j]
            size = 1 if (top := own.max()) < 256 else 2 if top < 65536 else 4
            out.append(bytes([size]) + own.astype(f"<u{size}").tobytes())
        return out


def dimensions(sizes: np.ndarray) -> np.ndarray:
    """Groups of a set's point: a power of two, at least GROUPS and a quarter of the size, so that a group holds four shingles or fewer on average."""
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 4)).clip(0).astype(np.int64))


def point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups: a shingle's group is its hash modulo their number."""
    return counts.reshape(-1, groups).sum(axis=0)


def coarse(column: pa.Array) -> np.ndarray:
    """The points with GROUPS coordinates each."""
    out = np.empty((len(column), GROUPS), dtype=np.int64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = folded(point(raw), GROUPS)
    return out


def reaches(a: bytes, b: bytes) -> bool:
    """Whether the bound of two points at their own resolution reaches the overlap asked for."""
    x, y = point(a), point(b)
    groups = min(len(x), len(y))
    return 9 * int(np.minimum(folded(x, groups), folded(y, groups)).sum()) >= 4 * int(x.sum() + y.sum())


class Recent:
    """Nodes that came by lately, one for each remainder, so the memory is fixed; a node that was pushed out is new again."""

    def __init__(self) -> None:
        self.last = np.arange(RECENT) ^ 1  # no node of a place

    def new(self, node: int) -> bool:
        at = node & (RECENT - 1)
        if self.last[at] == node:
            return False
        self.last[at] = node
        return True


_SCAN = "doc_id bigint, key bigint, n bigint, node bigint, point binary, shingle bigint, found bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, one for each shingle that is frequent in a run of documents, and one for each of low hash that several sets of a task share."""
    names = [c.split()[0] for c in _SCAN.split(", ")]
    nothing = lambda n, kind: pa.nulls(n, kind)
    recent = Recent()
    low, held, n_sets = [], 0, 0

    def counted(value: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        k = len(value)
        return pa.RecordBatch.from_arrays([nothing(k, pa.int64())] * 4 + [nothing(k, pa.binary()), pa.array(value.view(np.int64)), pa.array(found, pa.int64())], names)

    def shared() -> pa.RecordBatch:
        value, found = np.unique(np.concatenate(low), return_counts=True)
        often = found >= max(2, n_sets // SHARED)
        return counted(value[often], found[often])

    for batch in batches:
        for part in texts.parts(batch, size=RUN):
            sets = Sets(part.column("text"))
            some = sets.sizes > 0
            points = sets.points()
            # a point goes with the first row of its node in this task
            fresh = [has and recent.new(node) for node, has in zip(sets.names.tolist(), some.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("key"), pa.array(sets.sizes, pa.int64()), pa.array(sets.names, mask=~some), pa.array([p if f else None for p, f in zip(points, fresh)], pa.binary()),
                    nothing(len(some), pa.int64()), nothing(len(some), pa.int64()),
                ],
                names,
            )
            below = sets.values < np.uint64(LOW)
            value, found = np.unique(sets.values[~below], return_counts=True)
            often = found >= max(8, len(some) // 128)
            if often.any():
                yield counted(value[often], found[often])
            low.append(sets.values[below & np.array(fresh, dtype=bool)[sets.owner]])
            held, n_sets = held + len(low[-1]), n_sets + sum(fresh)
            if held > TALLY:
                yield shared()
                low, held, n_sets = [], 0, 0
    if held:
        yield shared()


def _fan_out(frequent: np.ndarray, level: np.ndarray):
    """Rows (shingle, node, size): the shingles of which similar sets share one; the size, and above its 32 bits the mean level of the set's shingles (in 1 / 4)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, recent = Lookup(frequent), Recent()
        for batch in batches:
            for part in texts.parts(batch, size=RUN):
                sets = Sets(part.column(0))
                levels = np.zeros(len(sets.values), dtype=np.int8)
                at, place = lookup.find(sets.values)
                levels[at] = level[place]
                weight = np.bincount(sets.owner[at], weights=level[place], minlength=len(sets.sizes))
                loud = weight > 0
                size = sets.sizes + ((4 * weight // np.maximum(sets.sizes, 1)).astype(np.int64) << 32)
                take = []
                for d in np.flatnonzero(sets.sizes).tolist():
                    if not recent.new(int(sets.names[d])):
                        continue
                    i, n = int(sets.first[d]), int(sets.sizes[d])
                    p = n + -4 * n // 5 + 1  # n - ceil(0.8 n) + 1
                    if loud[d] and levels[i : i + p].any():
                        quiet = np.flatnonzero(levels[i : i + n] == 0)[:p]
                        take.append(i + (quiet if len(quiet) == p else np.argsort(levels[i : i + n], kind="stable")[:p]))
                    else:
                        take.append(np.arange(i, i + p))
                if take:
                    take = np.concatenate(take)
                    owner = sets.owner[take]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sets.values[take].view(np.int64)), pa.array(sets.names[owner]), pa.array(size[owner], pa.int64())], ["shingle", "node", "size"]
                    )

    return rows


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose summed coordinate minima reach the overlap asked for."""
    for batch in batches:
        keep = [reaches(a, b) for a, b in zip(batch.column("point_a").to_pylist(), batch.column("point_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _leaves(points: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows in leaves of at most LEAF, by halving on the coordinate with the widest spread; first cut into runs of sizes within an eighth."""
    order = np.argsort(size, kind="stable")
    cuts, at = [], 0
    while (at := int(np.searchsorted(size[order], size[order[at]] * 9 // 8, side="right"))) < len(order):
        cuts.append(at)
    out, todo = [], np.split(order, cuts)
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = points[rows]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        half = len(rows) // 2
        todo += [rows[:half], rows[half:]]
    return out


def search(points: np.ndarray, part: np.ndarray | None = None, met: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) whose bound reaches the overlap asked for, by boxes of leaves and then by points; of different parts only,
    and with no bit of ``met`` in common, if these are given."""
    size = points.sum(axis=1)
    leaves = _leaves(points, size)
    top = np.stack([points[r].max(axis=0) for r in leaves])
    least, most = np.array([size[r].min() for r in leaves]), np.array([size[r].max() for r in leaves])
    for x, rows in enumerate(leaves):
        # the overlap asked for is at most the smaller size
        near = x + np.flatnonzero((5 * most[x:] >= 4 * least[x]) & (5 * most[x] >= 4 * least[x:]))
        near = near[9 * np.minimum(top[x], top[near]).sum(axis=1) >= 4 * (least[x] + least[near])]
        if not len(near):
            continue
        others = np.concatenate([leaves[y] for y in near])
        for i in rows.tolist():
            js = others[(others > i) | ~np.isin(others, rows)]
            js = js[(5 * size[js] >= 4 * size[i]) & (5 * size[i] >= 4 * size[js])]
            if part is not None:
                js = js[part[js] != part[i]]
            if met is not None and met.size:
                js = js[~(met[js] & met[i]).any(axis=1)]
            js = js[9 * np.minimum(points[i], points[js]).sum(axis=1) >= 4 * (size[i] + size[js])]
            if len(js):
                yield np.minimum(i, js), np.maximum(i, js)


def marks(lists: pa.ListArray) -> np.ndarray:
    """Bits of each list's values, as far as several lists have them, in words of 64; of many values the most common."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    value, place, n = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    bit = np.full(len(value), -1)
    often = np.argsort(-n, kind="stable")[:MARKS]
    often = often[n[often] > 1]
    bit[often] = np.arange(len(often))
    out = np.zeros((len(lists), (len(often) + 63) // 64), dtype=np.uint64)
    bits = bit[place]
    owner, bits = owner[bits >= 0], bits[bits >= 0]
    np.bitwise_or.at(out, (owner, bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return texts.mixed(a.astype(np.int64).view(np.uint64)) ^ b.astype(np.int64).view(np.uint64)


def _search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit; in each unit, surviving pairs of different components (and of different tiles, if the unit has two).

    Pairs listed in a column ``tried`` are left out, and so are, in units over SMALL, pairs whose lists in a column ``earlier`` share a unit: they meet there."""
    held: pa.Table | None = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        unit, node, part, tile, n = (rows.column(c).to_numpy() for c in ("unit", "node", "component", "tile", "n"))
        start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        stop = np.append(start[1:], len(unit))
        two = np.maximum.reduceat(tile, start) != np.minimum.reduceat(tile, start)
        two_tiles = np.repeat(two, stop - start)
        end = np.repeat(stop, stop - start)
        small = np.repeat(stop - start <= SMALL, stop - start)

        def good(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (part[i] != part[j]) & (~two_tiles[i] | (tile[i] != tile[j]))

        before = np.zeros(0, dtype=np.uint64)
        if "tried" in rows.column_names:
            tried = rows.column("tried").combine_chunks()
            before = pair_key(np.repeat(node, tried.value_lengths().fill_null(0).to_numpy()), tried.flatten().to_numpy())

        def untried(both: np.ndarray) -> pa.RecordBatch:
            a, b = np.minimum(node[both[:, 0]], node[both[:, 1]]), np.maximum(node[both[:, 0]], node[both[:, 1]])
            _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
            both = both[once[~np.isin(pair_key(a, b)[once], before)]]
            fine = np.flatnonzero(dimensions(n[both]).min(axis=1) > GROUPS)
            keep = np.ones(len(both), dtype=bool)
            for k in fine.tolist():  # at full resolution
                keep[k] = reaches(column[int(both[k, 0])].as_py(), column[int(both[k, 1])].as_py())
            both = both[keep]
            a, b = np.minimum(node[both[:, 0]], node[both[:, 1]]), np.maximum(node[both[:, 0]], node[both[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        found, size = [], 0
        column = rows.column("point").combine_chunks() if rows.num_rows else None
        base = np.flatnonzero(small)
        lag = 1
        if len(base):
            points = coarse(column.take(pa.array(base)))
            where = np.full(len(unit), -1)
            where[base] = np.arange(len(base))
        while len(base):
            base = base[base + lag < end[base]]
            base = base[5 * n[base] >= 4 * n[base + lag]]  # rows of a unit ascend by size
            i = base[good(base, base + lag)]
            for k in range(0, len(i), 4096):
                p = i[k : k + 4096]
                keep = 9 * np.minimum(points[where[p]], points[where[p + lag]]).sum(axis=1) >= 4 * (n[p] + n[p + lag])
                found.append(np.stack([p[keep], p[keep] + lag], axis=1))
                size += len(found[-1])
                if size > HELD:
                    yield untried(np.concatenate(found))
                    found, size = [], 0
            lag += 1
        for s, e in zip(start.tolist(), stop.tolist()):
            if e - s > SMALL:
                own = coarse(column.slice(s, e - s))
                met = marks(rows.column("earlier").combine_chunks().slice(s, e - s)) if "earlier" in rows.column_names else None
                for i, j in search(own, part[s:e], met):
                    keep = good(s + i, s + j)
                    found.append(np.stack([s + i[keep], s + j[keep]], axis=1))
                    size += len(found[-1])
                    if size > HELD:
                        yield untried(np.concatenate(found))
                        found, size = [], 0
        if size:
            yield untried(np.concatenate(found))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        unit = table.column("unit").to_numpy()
        last = int(np.searchsorted(unit, unit[-1]))  # units ascend within a partition
        if last:
            yield from pairs(table.slice(0, last))
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield from pairs(held)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in texts.parts(batch, size=RUN):
            sets = Sets(part.column("text"))
            raw = [sets.values[sets.first[d] : sets.first[d + 1]].tobytes() for d in range(part.num_rows)]
            same = pa.array(sets.names == part.column("node").to_numpy())  # a key may have other texts too
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(raw, pa.binary())], ["node", "values"]).filter(same)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("values_a"), batch.column("values_b")):  # one pair of sets at a time
            x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
            both = np.sort(np.concatenate([x, y]))
            overlap = int((both[1:] == both[:-1]).sum())
            keep.append(100 * overlap >= 80 * (len(x) + len(y) - overlap))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b), by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


class Join:
    """The stages of the join over one table of documents."""

    def __init__(self, documents: DataFrame) -> None:
        texts.small_batches(documents.sparkSession)
        text = F.col("text").cast("string")
        own = F.col("doc_id").cast("bigint")
        # the key finds a text again; a null id gets one from the text
        self.docs = documents.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64(text)).alias("key"), text.alias("text"))
        scanned = stored(self.docs.mapInArrow(_scan, _SCAN))
        self.rows = scanned.where("n IS NOT NULL").select("doc_id", "n", "node")
        #: one row a distinct set, with its smallest document
        self.nodes = stored(scanned.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.max("point").alias("point")))
        often = scanned.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("found").alias("found"))
        rows = self.rows.count()
        low = F.col("shingle").between(0, LOW - 1) & (F.col("found") >= LEAST) & (F.col("found") * SHARED >= rows)
        often = often.where(low | (F.col("found") * FREQUENT >= rows)).toPandas()  # at most SHARED times the low hashes of an average set, and FREQUENT times its shingles
        value = often["shingle"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(value)
        level = np.log2(often["found"].to_numpy().astype(float) + 1).astype(np.int8) + 1
        self.fan_out = self.docs.select("text").mapInArrow(_fan_out(value[order], level[order]), "shingle bigint, node bigint, size bigint")

    def members(self) -> DataFrame:
        """shingle, node, n, hub, of the fan-out groups with two nodes or more, one group for each set of members."""
        group = Window.partitionBy("shingle")
        # one shuffle of the rows: groups and members are found where they meet
        # the hub has the most of what many sets share: of edited copies of one text, the least edited
        hub = F.max(F.struct(F.shiftright("size", 32).alias("weight"), "node")).over(group)["node"]
        shared = self.fan_out.select("*", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high")).where("low <> high")
        shared = shared.select("shingle", "node", F.col("size").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("n"), hub.alias("hub"))
        found = stored(shared.dropDuplicates(["shingle", "node"]))
        same = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"), F.min("hub").alias("hub"))
        one = same.groupBy("members", "h", "hub").agg(F.min("shingle").alias("shingle"))
        return stored(found.join(one.select("shingle", "members"), "shingle"))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        point = self.nodes.select("node", "point")
        a = pairs.join(point.withColumnsRenamed({"node": "a", "point": "point_a"}), "a")
        return a.join(point.withColumnsRenamed({"node": "b", "point": "point_b"}), "b").select("a", "b", "point_a", "point_b").mapInArrow(_bounded, "a bigint, b bigint")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, from the whole sets of both."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stored(self.nodes.select("node", "key").join(wanted, "node"))
        # ids are sent to every task only if they are few
        by = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        texts_ = self.docs.join(by, "key").select("node", "text")
        sets = stored(texts_.mapInArrow(_sets, "node bigint, values binary").dropDuplicates(["node"]))
        a = pairs.join(sets.withColumnsRenamed({"node": "a", "values": "values_a"}), "a")
        return stored(a.join(sets.withColumnsRenamed({"node": "b", "values": "values_b"}), "b").select("a", "b", "values_a", "values_b").mapInArrow(_verified, "a bigint, b bigint"))

    def searched(self, members: DataFrame, links: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of different components whose bound reaches the overlap asked for, from the groups of ``members``, but for those tried."""
        part = components(links)
        labelled = members.where("members > 2").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
        left = labelled.join(open_, "shingle").select("shingle", "node", "component", "n", "members")
        # copies of one text meet in many large groups: there a pair is looked at in the first of them only
        large = left.where(F.col("members") > SMALL).groupBy("node").agg(F.collect_list("shingle").alias("large"))
        left = left.join(self.nodes.select("node", "point"), "node").join(large, "node", "left")
        earlier = F.when(F.col("members") > SMALL, F.filter("large", lambda s: s < F.col("shingle")))
        tiles = F.ceil(F.col("members") * 2 / TILE)
        tile = F.when(F.col("members") > TILE, F.pmod(F.xxhash64("node"), tiles)).otherwise(F.lit(0)).cast("int")
        spread = left.withColumn("tile", tile).withColumn("other", F.explode(F.when(F.col("members") > TILE, F.sequence(F.lit(0), (tiles - 1).cast("int"))).otherwise(F.array(F.lit(0)))))
        units = spread.select(F.xxhash64("shingle", F.least("tile", "other"), F.greatest("tile", "other")).alias("unit"), "node", "component", F.col("n").cast("bigint").alias("n"), "tile", "point", earlier.alias("earlier"))
        n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return units.repartition(n, "unit").sortWithinPartitions("unit", "n").mapInArrow(_search_groups, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti")

    def links(self) -> DataFrame:
        """Verified pairs that join all of each component; pairs within what is joined already are left out."""
        members = self.members()
        size = self.nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
        star = members.where("node <> hub").select("node", "hub", "n").distinct().join(size, "hub").where("5 * least(n, hub_n) >= 4 * greatest(n, hub_n)")
        tried = stored(self.bounded(star.select(F.col("hub").alias("a"), F.col("node").alias("b"))))
        links = self.verified(tried)
        # similar sets meet in many groups: a part of the groups joins most of them, and no pair is tried twice
        some = F.pmod(F.xxhash64("shingle"), F.lit(FIRST_GROUPS)) == 0
        for groups in (some, ~some):
            found = stored(self.searched(members.where(groups), links, tried))
            links, tried = links.unionByName(self.verified(found)), tried.unionByName(found)
        return links

    def classes(self) -> DataFrame:
        """doc_id, n_shingles and component_id, one row a document."""
        part = components(self.links())
        named = self.nodes.select("node", "doc_id").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of = named.join(ids, "component").select("node", "component_id")
        return self.rows.join(of, "node", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
        )


def report(documents: DataFrame) -> DataFrame:
    return Join(documents).classes().select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns; rows equal in id and text are one document.

    Rows without an id or without shingles stay. Rows that share a kept id but not the text all stay."""
    first = Join(documents).classes().where("n_shingles > 0").select(F.col("component_id").alias("_id")).distinct()
    names = documents.columns
    rows = documents.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)] + [F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text")])
    worded = F.coalesce(F.col("_text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) & F.col("_doc").isNotNull()
    same = Window.partitionBy("_doc", F.xxhash64("_text")).orderBy("_doc")
    kept = rows.where(worded).join(first, F.col("_doc") == F.col("_id"), "left_semi").withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
    return kept.unionByName(rows.where(~worded)).select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM overlap JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, w.doc_id) AS component_id FROM words w LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""
