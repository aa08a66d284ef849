import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from barweave.llm import substrings, texts


def brute(docs):
    """Rows equal in id and text are one document; the order is (id, nulls first; then the tag of the text), as documented."""
    distinct = list(dict.fromkeys(docs))
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in distinct}
    return distinct, words


def removed(order, words):
    seen, out = set(), {}
    for d in order:
        w, gone = words[d], set()
        fresh = []
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            if run in seen:
                gone |= set(range(i, i + 20))
            else:
                seen.add(run)
                fresh.append(run)
        out[d] = gone
    return out


def compare(make, docs, partitions=3):
    distinct, words = brute(docs)
    got = substrings.report(make(docs, partitions)).collect()
    assert len(got) == len(docs)
    ids = [d[0] for d in distinct]
    order = sorted(distinct, key=lambda d: (d[0] is not None, d[0] or 0))
    gone = removed(order, words)
    for r in got:
        options = []
        for d in distinct:
            if d[0] == r.doc_id:
                kept = " ".join(w for i, w in enumerate(words[d]) if i not in gone[d])
                options.append((len(words[d]), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
        if ids.count(r.doc_id) == 1:
            assert (r.n_words, r.n_removed, r.kept_sha256) == options[0], r.doc_id
        else:
            assert r.n_words in {o[0] for o in options}


def test_odd_rows(make, odd, clash):
    compare(lambda d, n: clash(make(d, n)), odd)
    assert substrings.report(make(odd).limit(0)).count() == 0


def test_brute_force(make):
    rng = random.Random(4)
    passage = [" ".join(f"p{k}w{j}" for j in range(rng.choice([19, 20, 21, 40, 90]))) for k in range(6)]
    docs = []
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice(passage) if rng.random() < 0.6 else " ".join(rng.choice("ab") for _ in range(rng.randrange(45))))
            if rng.random() < 0.3:
                parts.append(f"u{rng.randrange(10**6)}")
        docs.append((k, rng.choice([" ", "\n", "  "]).join(parts)))
    for partitions in (1, 5):
        rng.shuffle(docs)
        compare(make, docs, partitions)


def test_edits_around_a_node(make):
    """Near copies: one word changed at every place in turn, so that most nodes branch."""
    base = [f"w{j}" for j in range(70)]
    docs = [(0, " ".join(base))] + [(k + 1, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(70)]
    compare(make, docs)


def test_loops(make):
    compare(make, [(1, "lo " * 500), (2, "a b c " * 100), (3, "lo " * 19), (4, "x y " * 300 + "lo " * 30)])


def test_pieces_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(substrings, "MEMORY", 3)
    seen = substrings._Seen()
    assert seen.repeats(np.array([5, 5, 6], dtype=np.uint64), np.array([[2, 0], [1, 9], [1, 0]])).tolist() == [True, False, False]
    assert seen.repeats(np.array([5, 6, 7, 8], dtype=np.uint64), np.array([[0, 0], [1, 0], [1, 0], [1, 0]])).tolist() == [False, False, False, False]
    assert seen.repeats(np.array([5], dtype=np.uint64), np.array([[9, 9]])).tolist() == [False]  # forgotten: it goes through the shuffle


def test_windows_that_share_half_a_hash(make):
    """Different windows of one node whose hashes agree in the upper 32 bits."""
    phrase = " ".join(f"w{j}" for j in range(19))
    w = texts.words(pa.array([f"{phrase} x{k}" for k in range(300_000)]))
    at = np.flatnonzero(w.left() >= 20)
    edge = texts.windows(w.hashes, 20)[at]
    node = texts.sliding_min(texts.windows(w.hashes, substrings.INNER), 21 - substrings.INNER)[at]
    order = np.argsort(edge)
    i, j = order[:-1], order[1:]
    pairs = np.flatnonzero((edge[i] >> np.uint64(32) == edge[j] >> np.uint64(32)) & (node[i] == node[j]))
    assert len(pairs)
    for k in pairs[:2]:
        alike = [f"{phrase} x{i[k]}", f"{phrase} x{j[k]}"]
        compare(make, list(enumerate(alike)))
        compare(make, list(enumerate([*alike, f"{phrase} other", alike[0], alike[1] + " tail"])))


def test_a_piece_travels_as_four_numbers():
    """However long a piece is, its path does not go through the shuffle."""
    rng = random.Random(3)
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(5_000))] * 2)], ["doc_id", "tag", "text"])
    out = pa.Table.from_batches(substrings.pieces(iter([rows])))
    assert out.num_rows > 1_000 and all(pa.types.is_int64(f.type) for f in out.schema)
    assert out.column("path").null_count == out.num_rows // 2  # the second document's pieces repeat the first's


def test_branching_pieces_of_rows_that_are_there_twice(make):
    """The pieces of a node that branches are opened in the documents, of which some have the same id, or the same id and text."""
    base = [f"w{j}" for j in range(60)]
    docs = [(k, " ".join([*base[: 7 * k], "edit", *base[7 * k :]])) for k in range(8)]
    compare(make, [*docs, docs[3], docs[5], (None, " ".join(base)), (None, " ".join(base))])
