import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barweave.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).hexdigest(), text))
    for c in convs:
        convs[c] = [(r, t) for _, r, _, t in sorted(convs[c])]
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(convs.get(base, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    out = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()]
    return sorted(out, key=str)


def result(spark, rows, change=lambda df: df, **options):
    return sorted(map(tuple, trie.trie(change(spark.createDataFrame(rows, SCHEMA).repartition(5)), **options).collect()), key=str)


def some_turns():
    rng = random.Random(3)
    rows = [(c, k, rng.choice("ua"), rng.choice(["a", "bb", "ccc", "é😀"])) for c in [*range(0, 260), *range(-130, -90), 4096, 8191, 8192] for k in range(rng.choice([0, 1, 2, 4, 6, 9])) if c != 200]
    rows += [(300 + k, 0, "u", "only one turn") for k in range(12)]  # no base: turnless where a head is asked for
    rows += [(7, None, None, None), (7, None, "u", None), (7, 3, "b", "tie"), (7, 3, "a", "tie"), (7, 3, "a", "other"), (7, 3, "a", "other"), (None, 0, "u", "no conversation")]
    return rows


def test_brute_force_and_sql(spark, clash):
    rows = some_turns()
    want = brute(rows)
    assert result(spark, rows, clash) == want
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(trie.SQL).fetchall(), key=str) == want


def test_hot_conversation_and_hot_turn(spark, monkeypatch):
    """One conversation crosses many buckets and runs of turns; most conversations begin alike."""
    monkeypatch.setattr(trie, "RUN", 16)
    monkeypatch.setattr(trie, "IDS", 8)
    rng = random.Random(8)
    rows = [(5, k, "u", f"turn {k % 7}") for k in range(900)] + [(100 + k, t, "u", "hello" if t < 2 else rng.choice("xyz")) for k in range(200) for t in range(6)]
    rows += [(900 + k, t, "u", f"turn {t % 7}") for k in range(3) for t in range(700 + k)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(301, 0, "u", "x")], [(None, 1, "u", "x")], [(0, 0, "u", "x"), (0, 1, "u", "y" * 300_000)]])
def test_small_tables(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_collisions_are_found(spark, monkeypatch):
    """With tiny primes different prefixes collide: verification notices, and another base is tried until none does."""
    rows = [(c, k, "u", f"{c} {k}") for c in range(1, 40) for k in range(6)]
    monkeypatch.setattr(trie, "_P", (7, 11))
    with pytest.raises(RuntimeError):
        result(spark, rows, seeds=range(1, 3))
    few = [(c, k, "u", f"{c} {k}") for c in (1, 2) for k in range(8)]
    monkeypatch.setattr(trie, "_P", (31, 37))
    assert result(spark, few, seeds=range(1, 40)) == brute(few)


def test_own_rule_of_rebuilding(spark):
    """No head at all: the trie of the conversations as they are."""
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "c")]
    got = trie.trie(spark.createDataFrame(rows, SCHEMA), head=F.lit(0)).select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 2, 1), (1, 1, 2, 1, 1), (1, 2, 1, 1, 0), (3, 1, 1, 1, 0)]
