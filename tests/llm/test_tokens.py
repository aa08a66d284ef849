import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barweave.llm import binary, pack, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(library, odd):
    texts = [t or "" for _, t in odd] + ["a  b", " a", "a ", "\n \n x", "a\n b", "don't  stop", "<|endoftext|> x <|endoftext|>", "a  b  c", "x\u0085 y", "12 345,678", " ", "é è\té", "…!! ##  ok"]
    own = tokens.Encoder.of("byte_bpe_50k.json")
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode(texts)] == [encoded(library, t) for t in texts]


def test_pieces_put_together_are_exact(library):
    rng = random.Random(3)
    parts = ["Ab", "xy", "é", "ïßŁ", "ªµº", "à", "ɏ", "ɐ", "ж", "中", "\u0301", "7", "²", "_", ".", ",", "!!", "'", "'s", "n't", "\n", "\n", " ", " ", " ", "\t", "\u00a0", "\x1c", "<|endoftext|>", "<|", "…", "©", "Ġ", "Ã"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(4000)]
    own = tokens.Encoder(PATH)
    assert own.bare
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for i in range(0, len(texts), 500) for x in own.encode(texts[i : i + 500])] == [encoded(library, t) for t in texts]


def test_only_new_words_are_encoded(monkeypatch):
    """Punctuation and line ends around a word that was met do not make it a new one."""
    own = tokens.Encoder(PATH)
    asked = []
    monkeypatch.setattr(own, "_ask", lambda texts, ask=own._ask: asked.extend(texts) or ask(texts))
    own.encode(["one two three", "one! two, three..."])
    asked.clear()
    own.encode(["one two! two, one...\none three,", "one, three!"])
    assert not asked


def test_other_vocabularies_are_asked_whole(tmp_path, library):
    """Pieces are put together only for the pre-tokenizer that cuts between them."""
    about = json.loads(library.to_str())
    for change in ({"pre_tokenizer": {**about["pre_tokenizer"], "use_regex": False}}, {"normalizer": {"type": "Lowercase"}}, {"added_tokens": [{**about["added_tokens"][0], "content": "wo,"}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(about | change))
        assert not tokens.Encoder(str(path)).bare


def test_joined_crc32():
    raw = [b"abc", b"", b"x" * 3_000_000, b"\x00" * 10]
    assert tokens.joined_crc32([(len(r), zlib.crc32(r)) for r in raw]) == zlib.crc32(b"".join(raw))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for ids in ([], [0], [2, 50256, 7], list(range(70_000)), [2**32 - 1, 0, 5] * 9):
        block = np.array(ids, dtype=np.uint32)
        assert binary.from_planes(binary.to_planes(block, kind), len(block), kind).tolist() == ids


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 100)])
def test_file_round_trip(spark, make, odd, tmp_path, library, kind, block):
    path = f"{tmp_path}/{kind}"
    binary.write(make(odd), path, block=block, kind=kind)
    got = binary.read_digest(spark, path).orderBy("start").collect()
    own = {}
    for i, t in odd:
        own.setdefault(i, []).append(np.array([*encoded(library, t), 2], dtype="<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        match = [x for x in own[r.doc_id] if (len(x) // 4, zlib.crc32(x)) == (r.n_tokens, r.ids_crc32)]
        assert match
        own[r.doc_id].remove(match[0])
    ids = [x for r in binary.read_ids(spark, path).orderBy("part", "chunk").collect() for x in r.ids]
    assert len(ids) == at
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert [r.start for r in index] == [0, *np.cumsum([r.n_ids for r in index])[:-1].tolist()] and max(r.n_ids for r in index) <= block


def test_empty_files(spark, make, tmp_path):
    binary.write(make([(1, "x")]).limit(0), f"{tmp_path}/none")
    assert binary.read_digest(spark, f"{tmp_path}/none").count() == 0


def test_cuts_cover_every_length():
    for n in range(1, 4500):
        own = pack.cuts(n)
        assert sum(own) == n and min(own) > 0 and max(own) <= pack.CAPACITY
        assert len(own) <= n // pack.CAPACITY + 5


def test_packing(make, odd, library, clash):
    docs = odd + [(1000 + k, "some words to fill " * (k % 97)) for k in range(300)]
    rows = pack.pack(clash(make(docs, 9))).toPandas()
    sizes = {}
    for i, t in docs:
        sizes.setdefault(i, []).append(len(encoded(library, t)) + 1)
    assert sum(map(sum, sizes.values())) == rows["length"].sum()
    unique = {i: t for i, t in docs if i is not None and len(sizes[i]) == 1}
    for i, own in rows[rows["doc_id"].isin(unique)].sort_values("start").groupby("doc_id"):
        ids = np.array([*encoded(library, unique[int(i)]), 1], dtype="<u4")
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()]
        used = int(own["length"].sum())
        assert used <= pack.CAPACITY
        padding += 0 if used & (used - 1) == 0 else pack.CAPACITY - used
    assert padding < 0.02 * rows["length"].sum()
    assert pack.pack(make(odd).limit(0)).count() == 0
