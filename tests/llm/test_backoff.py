import math
import random
from collections import Counter

import numpy as np
import pytest

from barweave.llm import backoff


def brute(docs, share, seen=backoff.SEEN):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(t or "").translate(low).encode().split() for _, t in docs]
    ones = Counter(w for ws in words for w in ws)
    total = sum(ones.values())
    words = [[w if ones[w] * share >= total else None for w in ws] for ws in words]
    ones = Counter(w for ws in words for w in ws)
    twos = Counter(p for ws in words for p in zip(ws, ws[1:]))
    out = []
    for (i, _), ws in zip(docs, words):
        s = math.log10(ones[ws[0]] / total) if ws else 0.0
        for a, b in zip(ws, ws[1:]):
            s += math.log10(twos[a, b] / ones[a]) if twos[a, b] >= seen else math.log10(0.4 * ones[b] / total)
        out.append((i, len(ws), s))
    return out


def check(make, docs, share=backoff.KNOWN, frequent=backoff.FREQUENT, seen=backoff.SEEN):
    got = sorted(((r.doc_id, r.n_words, r.log_score, r.mean_log_score) for r in backoff.report(make(docs), share, frequent, seen=seen).collect()), key=str)
    want = sorted(brute(docs, share, seen), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[1], x[2])), sorted(want, key=lambda x: (str(x[0]), x[1], x[2]))):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4 * max(1, w[1] / 1000)
        assert g[3] is None if not w[1] else abs(g[3] - w[2] / w[1]) < 1e-4


def test_odd_rows(make, odd, clash):
    check(lambda d: clash(make(d)), odd)
    assert backoff.report(make(odd).limit(0)).count() == 0


@pytest.mark.parametrize("seen", [1, 2, 4])
@pytest.mark.parametrize("frequent", [0, 5, 256])
def test_brute_force(make, frequent, seen):
    """Frequent bigrams counted apart, or not, give the same scores."""
    rng = random.Random(1)
    docs = [(k, "the end " * rng.randrange(4) + " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(50)))) for k in range(120)]
    check(make, docs, frequent=frequent, seen=seen)


def test_unknown_words(make):
    docs = [(k, "a a a b b c d e " * (k + 1) + "b a a") for k in range(5)]
    docs[0] = (0, "a b c c c x y z")
    check(make, docs, 9)


@pytest.mark.parametrize("common", [1, 9, 60])
def test_words_that_are_not_common(make, odd, common):
    """Words whose counts stay in the table give the same scores as those sent to every task."""
    rng = random.Random(2)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(50)))) for k in range(120)]
    for some in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.report(make(some), common=common).collect()), key=str)
        for g, w in zip(got, sorted(brute(some, math.inf), key=str), strict=True):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4 * max(1, w[1] / 1000)
    check(make, docs, 1 << 20)  # one unknown word, but no word so rare


def test_no_word_is_cut_from_a_large_corpus(make):
    """More than 2**20 words, so that a word that occurs once is less than one in 2**20 of them."""
    docs = [(k, f"rare{k} " + "the end of it " * 5000 + f"pair{k // 2} of{k // 2} once{k}") for k in range(56)]
    assert sum(len(t.split()) for _, t in docs) > 1 << 20
    check(make, docs, math.inf)
    assert {r.doc_id: r.log_score for r in backoff.report(make(docs)).collect()} == {r.doc_id: r.log_score for r in backoff.report(make(docs), math.inf).collect()}


@pytest.mark.parametrize("seen", [2, 4])
@pytest.mark.parametrize("common", [1, 60])
def test_seldom_bigrams_of_words_that_are_not_common(make, common, seen):
    """The count of a second word is looked up where the bigram is seen too seldom."""
    rng = random.Random(5)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(50)))) for k in range(120)]
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.report(make(docs), common=common, seen=seen).collect()), key=str)
    for g, w in zip(got, sorted(brute(docs, math.inf, seen), key=str), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4


def test_entries_travel_in_few_bytes():
    """Blocks hold what was put in; an entry of common words takes far less than a row of two long numbers."""
    rng = np.random.RandomState(7)
    n = 100_000
    entries = [np.sort(rng.randint(0, 1 << 41, n)), np.zeros(n, dtype=np.int64), rng.randint(0, 4000, n), np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
    body = backoff._press(entries)
    assert len(body) < 7 * n and (backoff._open(body, n) == np.stack(entries)).all()
    few = [np.array(x) for x in ([-(2**63), 2**63 - 1], [2**63 - 1, -5], [0, 1], [1, 1 << 40], [1, 4])]
    assert (backoff._open(backoff._press(few), 2) == np.stack(few)).all()


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("common", [1, 60, 1 << 20])
def test_orders(make, odd, common, order):
    """Runs of three and four words are scored by their counts; shorter documents by the count of all their words in a row."""
    rng = random.Random(9)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.choice([0, 1, 2, 3, 4, 40])))) for k in range(150)]
    for some in (docs, odd):
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = [(t or "").translate(low).encode().split() for _, t in some]
        counts = [Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1)) for k in range(order + 1)]
        total = sum(counts[1].values())
        want = []
        for (d, _), w in zip(some, words):
            s = 0.0
            for i in range(len(w)):
                run = tuple(w[max(0, i - order + 1) : i + 1])
                s += math.log10(counts[len(run)][run] / (counts[len(run) - 1][run[:-1]] if len(run) > 1 else total))
            want.append((d, len(w), s))
        key = lambda x: (str(x[0]), x[1], round(x[2], 3))
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.report(make(some), common=common, order=order).collect()), key=key)
        for g, w in zip(got, sorted(want, key=key), strict=True):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4 * max(1, w[1] / 1000)


def test_orders_that_are_not_offered(make):
    for more in ({"order": 1}, {"order": 3, "seen": 2}, {"order": 3, "share": 100}):
        with pytest.raises(ValueError):
            backoff.report(make([(1, "a b")]), **more)
