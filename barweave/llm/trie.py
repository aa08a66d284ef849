"""Prefix trie of rebuilt conversations, from composable fingerprints.

A conversation is rebuilt as the first turns of its base conversation followed by its own turns after as many. No rebuilt text is
made: a run of turns has a polynomial fingerprint over two primes, and the fingerprint of two runs one after the other is a sum of
both, the second shifted by a power of the base. So the prefixes of a rebuilt conversation follow from the prefixes of its base
and of its own turns. Rebuilt prefixes are rows (conversation, depth, fingerprint, reference of the last turn's stored row).

Rows of equal depth and fingerprint form a node. Each group is verified: all rows must have the same parent fingerprint, and where
the last turn stands in more than one stored row, the SHA-256 digests of those rows, fetched by reference, must agree. By induction
over the depth a node then holds equal prefixes. If a group fails, everything is done again with another base.

A node belongs to its smallest member, whose nodes are one run of depths: a chain. Each chain hangs below one node of another chain, so a
subtree is the rest of the own chain and all chains that hang below it. Chains send their totals to the chains on their way
to the root (never more rows than there are rebuilt turns), and running sums up each chain give the subtrees.

One conversation, first turn or node may hold a third of the rows: turns are numbered by an ordered prefix over range buckets, joins on a
conversation go by runs of ``RUN`` turns, nodes with over a thousandth of the rows are broadcast (fewer than 1,000), all else are
aggregates with map-side combine. A SHA-256 must run over all ids of a node in order, so one task takes it from blocks of up to ``IDS`` joined ids.

Defined results: a null role or text is empty; rows without conv_id belong to no conversation; turns are ordered with null first, equal
ones by role, then by the SHA-256 of the text; further columns are ignored; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prefix
from ..session import stored
from .joins import spread_join

#: Every PERIOD-th conversation is a base; a head has fewer than HEADS turns.
PERIOD, HEADS = 100, 6
RUN, IDS = 4096, 4096
_P = ((1 << 31) - 1, (1 << 31) - 19)
_SHIFT = 1 << 31
_NONE = hashlib.sha256(b"").hexdigest()


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % PERIOD


def head_of(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _power(base: int, exponent: Column, p: int) -> Column:
    """base ** exponent modulo p, by squares; exponents below 2**31."""
    out = F.lit(1).cast("long")
    for k in range(31):
        out = out * F.when(F.shiftright(exponent, k).bitwiseAND(1) == 1, F.lit(pow(base, 1 << k, p))).otherwise(F.lit(1)) % p
    return out


def _bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{p}".encode()).digest()[:8], "big") % (p - 3) + 2 for p in _P]


def _packed(a: Column, b: Column) -> Column:
    return a * _SHIFT + b


def turns(conversations: DataFrame) -> DataFrame:
    """The stored turns in order of (conversation, turn): a row number, digests and code points in place of texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("tie"), digest.alias("digest"), F.length(text).alias("points")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(dealt.select("conv_id", "digest", "points", F.spark_partition_id().alias(prefix.BUCKET), F.monotonically_increasing_id().alias("row")))


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """Position of each stored turn in its conversation, and fingerprint of the conversation up to it (f) and before it (g), one for each prime."""
    bases = _bases(seed)
    inside = Window.partitionBy(prefix.BUCKET, "conv_id").orderBy("row")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = [F.pmod(F.xxhash64(F.lit(f"{seed}:{i}"), "digest"), F.lit(p)) for i, p in enumerate(_P)]
    here = rows.select("conv_id", prefix.BUCKET, "row", "points", F.row_number().over(inside).alias("at"), *[v.alias(f"h{i}") for i, v in enumerate(value)])
    both = list(enumerate(zip(bases, _P)))
    local = here.select("*", *[(F.col(f"h{i}") * _power(b, F.col("at"), p) % p).alias(f"w{i}") for i, (b, p) in both])

    # A bucket's turns of a conversation are a segment (length, fingerprint); segments combine from bucket to bucket.
    before = Window.partitionBy("conv_id").orderBy(prefix.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    segment = local.groupBy(prefix.BUCKET, "conv_id").agg(F.count(F.lit(1)).alias("long"), *[(F.sum(f"w{i}") % p).alias(f"s{i}") for i, (_, p) in both])
    placed = segment.select("*", F.coalesce(F.sum("long").over(before), F.lit(0)).alias("skip"))
    placed = placed.select("*", *[_power(b, F.col("skip"), p).alias(f"b{i}") for i, (b, p) in both])
    carry = placed.select(
        prefix.BUCKET, "conv_id", "skip", "b0", "b1",
        *[(F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"b{i}") % p).over(before), F.lit(0)) % p).alias(f"c{i}") for i, (_, p) in both],
    )
    sums = local.select("*", *[(F.sum(f"w{i}").over(upto) % p).alias(f"l{i}") for i, (_, p) in both])
    out = sums.join(carry, [prefix.BUCKET, "conv_id"])
    f = [(F.col(f"c{i}") + F.col(f"l{i}") * F.col(f"b{i}")) % p for i, (_, p) in both]
    g = [(f[i] + p - F.col(f"w{i}") * F.col(f"b{i}") % p) % p for i, (_, p) in both]
    return out.select(
        "conv_id", (F.col("skip") + F.col("at")).cast("int").alias("pos"), *[x.alias(f"f{i}") for i, x in enumerate(f)], *[x.alias(f"g{i}") for i, x in enumerate(g)], "points", "row"
    )


def rebuilt(known: DataFrame, seed: int, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt length, rebuilt prefixes) from the stored prefixes.

    ``base`` and ``head`` are columns of conv_id: whose first turns come first, and how many of them (fewer than ``most``).
    """
    bases = _bases(seed)
    known = known.withColumn("h", head)
    at_head = [F.max(F.when(F.col("pos") == F.col("h"), F.col(f"f{i}"))).alias(f"own{i}") for i in range(2)]
    convs = known.groupBy("conv_id", "h").agg(F.max("pos").alias("n"), *at_head).withColumn("base", base)
    first = F.struct("pos", "f0", "f1", "g0", "g1", "points", "row")
    heads = known.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(first)).alias("head"))  # fewer than `most` turns
    convs = convs.join(heads.join(convs.select("base").distinct(), "base", "left_semi"), "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.greatest("h", F.lit(0))))
    convs = convs.withColumn("k", F.size("head"))
    last = F.when(F.col("k") > 0, F.element_at("head", F.greatest("k", F.lit(1))))
    convs = convs.select(
        "conv_id", "n", "k", "h", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        *[F.coalesce(last[f"f{i}"], F.lit(0)).alias(f"head{i}") for i in range(2)], *[F.coalesce(f"own{i}", F.lit(0)).alias(f"own{i}") for i in range(2)],
    )
    convs = stored(convs)
    at = F.explode("head").alias("t")
    heads = convs.select("conv_id", "len", at).select(
        "conv_id", "len", F.col("t.pos").alias("depth"), _packed(F.col("t.f0"), F.col("t.f1")).alias("f"), _packed(F.col("t.g0"), F.col("t.g1")).alias("g"), "t.points", "t.row"
    )
    runs = convs.filter("n > h").select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / RUN).cast("int"))).alias("run")).drop("head", "h", "n")
    own = known.filter("pos > h").withColumn("run", F.floor(F.col("pos") / RUN).cast("int")).join(runs, ["conv_id", "run"])
    back = [F.element_at(F.array(*[F.lit(pow(b, -s, p)) for s in range(most)]), F.col("h") - F.col("k") + 1) for b, p in zip(bases, _P)]

    def joined(name: str, i: int) -> Column:
        p = _P[i]
        return (F.col(f"head{i}") + (F.col(f"{name}{i}") + p - F.col(f"own{i}")) % p * back[i]) % p

    tails = own.select(
        "conv_id", "len", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), _packed(joined("f", 0), joined("f", 1)).alias("f"), _packed(joined("g", 0), joined("g", 1)).alias("g"), "points", "row"
    )
    return convs.select("conv_id", "len"), heads.unionByName(tails)


def _members(rows: DataFrame, base: Column, head: Column, most: int, seeds: range) -> tuple[DataFrame, DataFrame]:
    """(conversations, rebuilt prefixes with the owner and size of their node), verified."""
    for seed in seeds:
        known = stored(prefixes(rows, seed))
        convs, every = rebuilt(known, seed, base, head, most)
        every = stored(every)
        nodes = stored(
            every.groupBy("depth", "f").agg(
                F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), (F.min("g") == F.max("g")).alias("same"), (F.min("row") < F.max("row")).alias("several"),
            )
        )
        owned = stored(spread_join(every.drop("g"), nodes.drop("same").withColumn("rows", F.col("n_convs")), ["depth", "f"], "rows").drop("f"))
        cited = owned.filter("several").select("owner", "depth", "row").distinct().join(rows.select("row", "digest"), "row")
        differ = cited.groupBy("owner", "depth").agg((F.min("digest") != F.max("digest")).alias("differ")).filter("differ")
        if nodes.filter(~F.col("same")).isEmpty() and differ.isEmpty():
            return convs, owned
    raise RuntimeError("fingerprints collide for every base tried")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined ids of each node, from blocks in order."""
    key, digest, out = None, None, []

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], ["owner", "depth", "ends_sha256"])
        out.clear()
        return done

    for batch in batches:
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (owner, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield flush()
    if key is not None:
        out.append((*key, digest.hexdigest()))
        yield flush()


def ends(owned: DataFrame, convs: DataFrame) -> DataFrame:
    """Digest of the conversations that end at a node (owner, depth); the root's owner is written 0."""
    last = owned.filter("depth = len").select("owner", "depth", "conv_id").unionByName(convs.filter("len = 0").select(F.lit(0).cast("long").alias("owner"), F.lit(0).alias("depth"), "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = last.groupBy("owner", "depth", F.floor(F.col("conv_id") / F.lit(IDS)).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").select("owner", "depth", "ids").mapInArrow(_hashed, "owner bigint, depth int, ends_sha256 string")


def trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, most: int = HEADS, seeds: range = range(1, 6)) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    conv_id = F.col("conv_id")
    convs, owned = _members(turns(conversations), base_of(conv_id) if base is None else base, head_of(conv_id) if head is None else head, most, seeds)
    weight = (F.col("n_convs") - 1) * F.col("points")
    own = owned.filter("owner = conv_id")
    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum(weight).alias("saved"))
    above = owned.filter("owner != conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))
    hung = stored(above.join(chains, "conv_id"))  # one row a chain and chain above it, with the depth where their ways part
    direct = hung.filter("depth = top - 1")
    branches = direct.groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("branches"))
    closed = branches.select(F.col("owner").alias("conv_id"), F.col("depth").alias("end"), F.lit(0).alias("leaf"))
    below = hung.join(closed, ["conv_id", "end"], "left").groupBy("owner", "depth").agg(F.sum("saved").alias("saved"), F.sum(F.coalesce("leaf", F.lit(1))).alias("leaves"), F.sum((F.col("depth") == F.col("top") - 1).cast("int")).alias("branches"))
    starts = direct.select("conv_id", F.col("top").alias("depth"), F.col("owner").alias("parent"))

    nodes = own.select("owner", "depth", "n_convs", weight.alias("saved"), (F.col("depth") < F.col("len")).cast("int").alias("goes_on"))
    nodes = nodes.join(below.withColumnsRenamed({"saved": "hung_saved", "leaves": "hung_leaves"}), ["owner", "depth"], "left").fillna(0, ["hung_saved", "hung_leaves", "branches"])
    nodes = nodes.withColumn("n_children", F.col("goes_on") + F.col("branches"))
    nodes = nodes.select("owner", "depth", "n_convs", "n_children", (F.col("saved") + F.col("hung_saved")).alias("saved"), (F.col("hung_leaves") + (F.col("n_children") == 0).cast("int")).alias("leaves"))
    nodes = prefix.ordered(nodes, ["owner"], [F.col("depth").desc()], sums={"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")})
    parent = starts.select(F.col("conv_id").alias("owner"), "depth", "parent")
    facts = convs.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"))  # one row
    nodes = nodes.join(parent, ["owner", "depth"], "left").crossJoin(F.broadcast(facts.select("least")))
    # The first node of a chain hangs below the node found above, at depth 1 below the root.
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.coalesce("parent", "owner")))
    names = ["owner", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = own.agg(F.sum((F.col("depth") == 1).cast("long")).alias("n_children"), F.sum(weight).alias("saved_tokens"))
    leaves = chains.join(closed, (chains["conv_id"] == closed["conv_id"]) & (chains["end"] == closed["end"]), "left_anti").agg(F.count(F.lit(1)).alias("n_leaves"))
    root = facts.crossJoin(tops).crossJoin(leaves).filter("n_convs > 0").select(  # one row each
        F.col("least").alias("owner"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    every = nodes.select(names).unionByName(root.select(names)).withColumn("_at", F.when(F.col("depth") == 0, 0).otherwise(F.col("owner")))
    out = every.join(ends(owned, convs).withColumnRenamed("owner", "_at"), ["_at", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), *[F.col(c).cast("long").alias(c) for c in names[1:]], F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")
    )


def report(conversations: DataFrame) -> DataFrame:
    return trie(conversations)


SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
heads AS (SELECT c, n, c - c % 100 AS base, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, x: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, x)), 4294967295::BIGINT)) % 6 AS h FROM sizes),
convs AS (SELECT a.c, a.n, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM heads a LEFT JOIN sizes b ON b.c = a.base),
rebuilt AS (SELECT v.c, t.pos AS d, role, text FROM convs v JOIN t ON t.c = v.base AND t.pos <= v.h
    UNION ALL SELECT v.c, v.k + t.pos - v.h AS d, role, text FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h),
paths AS (SELECT c, d, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, length(text) AS points FROM rebuilt
    UNION ALL SELECT c, 0, [], 0 FROM convs),
member AS (SELECT c, d, path, points, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (SELECT d, path, path[1:d - 1] AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY d, path),
children AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN children k ON k.d = x.d AND k.path = x.path)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, count(*) FILTER (y.n_children = 0) AS n_leaves,
    sum(y.saved)::BIGINT AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN full_nodes y ON y.d >= x.d AND y.path[1:x.d] = x.path LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = x.up AND x.d > 0
GROUP BY x.conv_id, x.d, p.conv_id, x.n_convs, x.n_children, x.ends_sha256, x.path"""
