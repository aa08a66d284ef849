import hashlib
import random

from barweave.llm import fingerprints as fp


def test_spans_and_extensions():
    rng = random.Random(2)
    a = "".join(rng.choice("abé😀") for _ in range(300))
    b = a[:120] + "#" + a[120:250] + "".join(rng.choice("ab") for _ in range(40))
    x, y = fp.Prefix(a), fp.Prefix(b)
    for _ in range(200):
        i, j, n = rng.randrange(len(a)), rng.randrange(len(b)), rng.randrange(1, 20)
        if i + n <= len(a) and j + n <= len(b):
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert x.extension(i, y, j) == common
    assert x.extension(0, y, 0) == 120 and x.extension(120, y, 121) >= 130


def test_likeness():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    for n in (1, 5, 40, 3000):
        a, b = " ".join(word() for _ in range(n)), " ".join(word() for _ in range(n))
        f, g, h = fp.fingerprint(a), fp.fingerprint(b), fp.fingerprint(fp.edited(a, b))
        assert fp.likeness(f, f) == 1 and f == fp.fingerprint(a)
        assert fp.likeness(f, g) == fp.likeness(g, f) and 0 <= fp.likeness(f, g) < 1
        if n >= 40:
            assert fp.likeness(f, h) > 0.55 and fp.likeness(f, g) < 0.2
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0
    scattered = list(a)
    for i in range(0, len(a), 400):
        scattered[i] = "Z"
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint("".join(scattered))) > 0.5
    assert len(fp.fingerprint("ab" * 100_000)) < 700


def test_report(spark, make, odd, clash):
    for pairs in (odd, odd[:1], [(k, f"text {k} " * (k % 7)) for k in range(200)]):
        got = fp.report(clash(make(pairs, 7))).collect()
        assert len(got) == len(pairs)
        texts = {}
        for i, t in pairs:
            texts.setdefault(i, []).append(t or "")
        order = sorted(texts, key=lambda i: -(2**63) if i is None else i, reverse=True)
        for r in got:
            assert r.fingerprint in {fp.fingerprint(t) for t in texts[r.doc_id]} and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if len(texts[r.doc_id]) == 1:
                t = texts[r.doc_id][0]
                nexts = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
                made = {hashlib.sha256(fp.edited(t, x).encode()).hexdigest() for x in nexts}
                assert r.n_chars == len(t) and r.edited_sha256 in made
    assert fp.report(make(odd).limit(0)).count() == 0
