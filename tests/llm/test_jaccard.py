import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barweave.llm import jaccard


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str), links


def check(make, docs, partitions=3):
    got = sorted((tuple(r) for r in jaccard.report(make(docs, partitions)).collect()), key=str)
    assert got == brute(docs)[0]


def test_odd_rows(make, odd, clash):
    docs = clash(make(odd))
    got = sorted((tuple(r) for r in jaccard.report(docs).collect()), key=str)
    assert got == brute(odd)[0]
    kept = jaccard.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    stay = {d for d, n, c in brute(odd)[0] if n and d == c and d is not None}
    expected = [d for d, t in set(odd) if d in stay and shingles(t)] + [d for d, t in odd if d is None or not shingles(t)]
    assert 1 in stay and not {2, 8, 11, 15} & stay
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert jaccard.report(docs.limit(0)).count() == 0


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("limits", [{}, {"TILE": 6}, {"FREQUENT": 0, "SENT": 0}])
def test_brute_force(make, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(6)
    passage = [f"pass{j}" for j in range(20)]
    docs, k = [], 0
    for family in range(8):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(rng.choice([4, 6, 9, 40, 150]))]
        for _ in range(rng.choice([1, 3, 14])):
            docs.append((k, " ".join(near(rng, base, rng.choice([0, 1, 2, 3])))))
            k += 1
    for _ in range(25):  # a passage that many documents share
        docs.append((k, " ".join([*passage, *(f"u{rng.randrange(10**5)}" for _ in range(rng.choice([2, 3, 5, 30])))])))
        k += 1
    rng.shuffle(docs)
    check(make, docs)


def test_chain_and_thresholds(make):
    """Exactly 80 in 100 links, 79 does not; a chain of links is one component though its ends share little."""
    w = [f"w{j}" for j in range(400)]
    docs = [(k, " ".join(w[10 * k : 10 * k + 124])) for k in range(20)]
    docs += [(100, " ".join(f"x{j}" for j in range(84))), (101, " ".join(f"x{j}" for j in range(104))), (102, " ".join(f"y{j}" for j in range(83))), (103, " ".join(f"y{j}" for j in range(104)))]
    check(make, docs)


def test_long_texts(make):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    docs = [(1, " ".join(base)), (2, " ".join(near(rng, base, 60))), (3, " ".join(near(rng, base, 200))), (4, " ".join(near(rng, base, 500))), (5, " ".join(base[:5000])), (6, " ".join(base[:4700]))]
    check(make, docs)


def test_bound_is_a_bound():
    import pyarrow as pa

    rng = random.Random(9)
    for size in (3, 60, 900, 5000):
        base = [f"w{rng.randrange(size)}" for _ in range(size)]
        texts = [" ".join(near(rng, base, e)) for e in (0, size // 50, size // 20, size // 5)]
        sets = jaccard.Sets(pa.array(texts))
        points = sets.points()
        for i in range(4):
            for j in range(i):
                a, b = (set(sets.values[sets.first[x] : sets.first[x + 1]].tolist()) for x in (i, j))
                x, y = jaccard.point(points[i]), jaccard.point(points[j])
                g = min(len(x), len(y))
                assert np.minimum(jaccard.folded(x, g), jaccard.folded(y, g)).sum() >= len(a & b)
                if 100 * len(a & b) >= 80 * len(a | b):
                    assert jaccard.reaches(points[i], points[j])


def test_search_finds_all_pairs_within_the_bound(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    rng = np.random.RandomState(1)
    centres = rng.poisson(3, (6, jaccard.GROUPS))
    points = np.concatenate([np.maximum(0, c + rng.randint(-1, 2, (15, jaccard.GROUPS)) * (rng.rand(15, jaccard.GROUPS) < p)) for c, p in zip(centres, [0, 0.1, 0.2, 0.3, 0.5, 1])])
    found = {(i, j) for a, b in jaccard.search(points) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(points)) for i in range(j) if 9 * np.minimum(points[i], points[j]).sum() >= 4 * (points[i].sum() + points[j].sum())}
    assert found == want and 100 < len(want) < 1200


def test_groups_in_batches():
    import pyarrow as pa

    rng = np.random.RandomState(2)
    rows = []
    for unit in range(40):
        base = rng.poisson(2, jaccard.GROUPS)
        for k in range(rng.choice([2, 5, 60])):
            own = np.maximum(0, base - (rng.rand(jaccard.GROUPS) < rng.choice([0.05, 0.4])))
            rows.append((unit, unit * 100 + k, rng.randint(3), int(own.sum()), rng.randint(2) if unit % 4 == 0 else 0, own))
    rows.sort(key=lambda r: (r[0], r[3]))
    kinds = [("unit", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("tile", pa.int32())]
    table = pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)] + [pa.array([b"\x01" + r[5].astype("u1").tobytes() for r in rows])], names=[n for n, _ in kinds] + ["point"])
    skipped = {(u * 100, u * 100 + 1) for u in range(0, 40, 3)}
    lists = pa.array([[b for a, b in skipped if a == r[1]] or None for r in rows], pa.list_(pa.int64()))
    table = table.append_column("tried", lists)
    got = sorted((a, b) for x in jaccard._search_groups(iter(table.to_batches(max_chunksize=37))) for a, b in zip(*(c.to_pylist() for c in x.columns)))
    want = []
    for u in range(40):
        own = [r for r in rows if r[0] == u]
        two = len({r[4] for r in own}) > 1
        want += [
            (min(x[1], y[1]), max(x[1], y[1])) for j, y in enumerate(own) for x in own[:j]
            if x[2] != y[2] and (not two or x[4] != y[4]) and 9 * np.minimum(x[5], y[5]).sum() >= 4 * (x[3] + y[3])
        ]
    assert got == sorted(x for x in want if x not in skipped) and skipped & set(want)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in up)


def test_a_task_forgets_and_hands_on(monkeypatch):
    """With room for two nodes and three pairs a task sends the same rows, some of them again."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(150):
        own = list(base) if i % 2 else [f"v{rng.randrange(60)}" for _ in range(30)]
        own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        docs += [" ".join(own)] * (1 + i % 3)
    ids = pa.array(range(len(docs)), pa.int64())
    sets = jaccard.Sets(pa.array(docs))
    _, first = np.unique(sets.names, return_index=True)
    units = np.sort(np.arange(len(first)) % 4 == 0)  # one unit of more than SMALL nodes, one of fewer
    order = np.lexsort((sets.sizes[first], units))
    first = first[order]
    points = sets.points()
    columns = {
        "unit": pa.array(units.astype(np.int64)), "node": pa.array(sets.names[first]), "component": pa.array(np.arange(len(first))), "tile": pa.array(np.zeros(len(first), dtype=np.int32)),
        "n": pa.array(sets.sizes[first].astype(np.int64)), "point": pa.array([points[i] for i in first], pa.binary()), "tried": pa.nulls(len(first), pa.list_(pa.int64())),
    }
    none = np.zeros(0, dtype=np.uint64)

    def rows(batches):
        return [tuple(r.values()) for b in batches for r in b.to_pylist()]

    def sent():
        scan = pa.RecordBatch.from_arrays([ids, ids, pa.array(docs)], ["doc_id", "key", "text"])
        own = [b for b in jaccard._scan(iter([scan]))]
        with_point = [(node, point) for b in own for node, point in zip(b.column("node").to_pylist(), b.column("point").to_pylist()) if point is not None]
        fan = rows(jaccard._fan_out(none, none.astype(np.int8))(iter([pa.RecordBatch.from_arrays([pa.array(docs)], ["text"])])))
        return with_point, fan, rows(jaccard._search_groups(iter([pa.RecordBatch.from_pydict(columns)])))

    whole = sent()
    assert len(whole[2]) > 500 and len(set(whole[2])) == len(whole[2])
    monkeypatch.setattr(jaccard, "RECENT", 2)
    monkeypatch.setattr(jaccard, "HELD", 3)
    narrow = sent()
    assert [set(x) for x in narrow] == [set(x) for x in whole]
    assert len(narrow[0]) > len(whole[0]) and len(narrow[1]) > len(whole[1]) and len(narrow[2]) == len(whole[2])
    recent = jaccard.Recent()
    assert [recent.new(v) for v in (5, 5, -7, 0, 1, 0, 5)] == [True, False, True, True, True, False, True]


def test_fan_out_goes_through_one_shuffle(make, odd, monkeypatch):
    plans, write = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    join = jaccard.Join(make(odd))
    plans.clear()
    join.members()
    assert sum(p.count("MapInArrow") for p in plans) == 1


def test_common_phrases_gather_no_unlike_documents(make):
    """Phrases that one document in ten has, in no run of documents frequent, come last in the order: no group has all documents with a phrase."""
    rng = random.Random(12)
    phrases = [[f"ph{i}w{j}" for j in range(9)] for i in range(20)]
    docs = []
    for k in range(400):
        own = [f"d{k}w{j}" for j in range(80)]
        for phrase in rng.sample(phrases, 2):
            at = rng.randrange(len(own))
            own[at:at] = phrase
        docs.append((k, " ".join(own)))
    docs += [(400 + k, t.replace(f"d{k}w7 ", "changed ")) for k, t in docs[:30]]
    join = jaccard.Join(make(docs, 12))
    members = join.members().groupBy("shingle").count().collect()
    assert members and max(r["count"] for r in members) < 16
    check(make, docs)


def test_least_edited_copy_is_the_hub(make):
    """Copies edited far apart join in the star round, through the copy that all of them come from."""
    rng = random.Random(13)
    base = [f"b{j}" for j in range(150)]
    docs = [(0, " ".join(base))] + [(k, " ".join(near(rng, base, 3))) for k in range(1, 200)]
    join = jaccard.Join(make(docs))
    members = join.members()
    hubs = {r.hub for r in members.select("hub", "members").distinct().collect() if r.members > 150}
    assert hubs == {r.node for r in join.nodes.where("doc_id = 0").collect()}
    check(make, docs)


def test_pairs_of_large_groups_meet_once(monkeypatch):
    """Nodes that share several large groups are held against each other in the first one only; all pairs are found."""
    monkeypatch.setattr(jaccard, "SMALL", 5)
    rng = np.random.RandomState(14)
    base = rng.poisson(2, jaccard.GROUPS)
    points = [np.maximum(0, base - (rng.rand(jaccard.GROUPS) < 0.1)) for _ in range(40)]
    groups = [np.sort(rng.choice(40, 20, replace=False)) for _ in range(6)]
    rows = [(g, k, int(points[k].sum()), [h for h in range(g) if k in groups[h]]) for g, own in enumerate(groups) for k in own.tolist()]
    rows.sort(key=lambda r: (r[0], r[2]))
    table = pa.table(
        {
            "unit": pa.array([r[0] for r in rows], pa.int64()), "node": pa.array([r[1] for r in rows], pa.int64()), "component": pa.array([r[1] // 2 for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64()),
            "tile": pa.array([0] * len(rows), pa.int32()), "point": pa.array([b"\x01" + points[r[1]].astype("u1").tobytes() for r in rows]), "earlier": pa.array([r[3] or None for r in rows], pa.list_(pa.int64())),
        }
    )

    def pairs(t):
        return [(a, b) for x in jaccard._search_groups(iter(t.to_batches())) for a, b in zip(*(c.to_pylist() for c in x.columns))]

    once, often = pairs(table), pairs(table.drop_columns("earlier"))
    assert len(set(once)) == len(once) and set(once) == set(often) and len(set(often)) > 100
    seen = []
    search = jaccard.search
    monkeypatch.setattr(jaccard, "search", lambda *a: (seen.append((i, j)) or (i, j) for i, j in search(*a)))
    pairs(table.drop_columns("earlier"))
    many, seen[:] = sum(len(i) for i, _ in seen), []
    pairs(table)
    assert sum(len(i) for i, _ in seen) == len(once) < many
    monkeypatch.setattr(jaccard, "MARKS", 1)
    assert set(pairs(table)) == set(often)
