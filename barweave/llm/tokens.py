"""Token ids of whole texts with a public byte-level BPE vocabulary, for use inside tasks.

A byte-level BPE never merges across the start of a " word", so the pieces between single spaces can be encoded on
their own. Each worker keeps the ids of pieces it has met, up to ``MEMORY`` pieces, and asks the tokenizers library only
for new ones; a text with a piece that starts or ends in white space, or two spaces in a row, is encoded as a whole.

The pre-tokenizer also cuts at a line end between two other characters, and between a letter and punctuation behind it. A new piece is
put together from its lines, and a line that is a Latin word with punctuation behind from the two, so that only new words are
encoded. A Latin word is one pre-token: ``JOINED`` of them go to the library's model in one call without a pre-tokenizer, and the ids are
cut where a token begins with the space. Any other piece, or any at all if the vocabulary has other rules, is encoded by the library as it is.
"""

from __future__ import annotations

import json
import os
import re
import time
import zlib

import numpy as np

#: Pieces remembered by a worker.
MEMORY = 400_000
#: New words encoded in one call.
JOINED = 50
VOCABULARY = "byte_bpe_50k.json"
#: Seconds without a call after which a worker forgets its vocabularies.
IDLE = 15
_LOADED: dict[str, Encoder] = {}
_LAST = 0.0
#: ASCII punctuation but the apostrophe, which may begin a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in a byte-level vocabulary, and those that stand for each Latin letter.
_BYTES = dict(zip([*_PRINTED, *sorted(set(range(256)) - set(_PRINTED))], map(chr, [*_PRINTED, *range(256, 324)])))
_SPACE = _BYTES[32]
_LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(128, 0x250)}


#: Outside the blocks in which every version of Unicode has the same letters.
_FOREIGN = re.compile("[^\x00-\u024f]")


def forget_idle() -> None:
    if _LOADED and time.monotonic() - _LAST > IDLE:
        _LOADED.clear()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bare = self._bare(Tokenizer)
        if self.bare:
            tokens = self.library.get_vocab()
            self.begins = np.zeros(max(tokens.values()) + 1, dtype=bool)
            self.begins[[i for t, i in tokens.items() if t.startswith(_SPACE)]] = True
            self.line_end = self._ask(["\n"])[0]
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}

    @staticmethod
    def of(vocabulary: str) -> Encoder:
        """One encoder a worker process and vocabulary: a path, or the name of a file of ``public_tokenizers``."""
        if vocabulary not in _LOADED:
            path = vocabulary
            if not os.path.exists(path):
                import public_tokenizers

                path = public_tokenizers.path(vocabulary)
            _LOADED[vocabulary] = Encoder(path)
        return _LOADED[vocabulary]

    def _bare(self, kind: type):
        """The library's model alone, if words can go to it by themselves; else None."""
        rules = json.loads(self.library.to_str())
        cut, model = rules["pre_tokenizer"] or {}, rules["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not model["dropout"] and not (rules["normalizer"] or rules["truncation"] or rules["padding"])
        # added tokens are found before anything is cut: none may lie in a word with punctuation behind, or reach over white space
        for added in rules["added_tokens"]:
            token = added["content"]
            plain = plain and not token[:1].isalpha() and token.strip(_MARKS) and not (added["lstrip"] or added["rstrip"] or any(c.isspace() for c in token))
        return kind(self.library.model) if plain else None

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of Latin words, all of them behind a space or none."""
        texts = [w if w.isascii() else w.translate(_LETTERS) for w in words]
        if before:
            texts = [_SPACE + t for t in texts]
            runs = ["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
            ids = np.array([i for e in self.bare.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], dtype="<u4")
            cut = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(cut) == len(words):  # else a token reaches over two words
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)])]
        return [np.array([t.id for t in self.bare.model.tokenize(t)], dtype="<u4").tobytes() for t in texts]

    def _compose(self, known: dict[str, bytes | None], pieces: set[str], before: str) -> set[str]:
        """Learns the pieces that can be put together; returns the others."""
        words = {p for p in pieces if p.isalpha()}
        other = pieces - words
        lines = {p: p.split("\n") for p in other if "\n" in p}
        if lines:
            self._learn(known, {x[0] for x in lines.values()}.difference(known, words), before)
            self._learn(self.first, {y for x in lines.values() for y in x[1:]}.difference(self.first), "")
        made = [(p, w, p[len(w) :]) for p, w in [(p, p.rstrip(_MARKS)) for p in other] if w.isalpha()]
        words.update([w for _, w, _ in made])
        if _FOREIGN.search("".join(words)):
            words = {w for w in words if not _FOREIGN.search(w)}
            made = [x for x in made if x[1] in words]
        words = [w for w in words if known.get(w) is None]
        known.update(zip(words, self._words(words, before)))
        marks = list({m for _, _, m in made}.difference(self.marks))
        self.marks.update(zip(marks, self._ask(marks)))
        known.update([(p, known[w] + self.marks[m]) for p, w, m in made])
        for p, x in lines.items():
            ids = [known.get(x[0]), *map(self.first.get, x[1:])]
            if None not in ids:
                known[p] = self.line_end.join(ids)
        return {p for p in pieces if known.get(p) is None}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes | None], pieces: set[str], before: str) -> None:
        if pieces and self.bare:
            pieces = self._compose(known, pieces, before)
        known.update(dict.fromkeys(pieces))
        whole = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(zip(whole, self._ask([before + p for p in whole])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        global _LAST
        _LAST = time.monotonic()
        if len(self.first) + len(self.rest) + len(self.marks) > MEMORY:
            self.first, self.rest, self.marks = {}, {}, {}
        first, rest = self.first, self.rest
        pieces = [t.split(" ") for t in texts]
        heads, pieces = [p[0] for p in pieces], [p[1:] for p in pieces]
        self._learn(first, {h for h in heads if h}.difference(first), "")
        self._learn(rest, set().union(*pieces).difference(rest), " ")
        out: list[bytes | None] = []
        for head, own in zip(heads, pieces):
            try:
                out.append((first[head] if head else b"") + b"".join(map(rest.__getitem__, own)))
            except TypeError:
                out.append(None)
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._ask([texts[i] for i in left])):
            out[i] = ids
        return out


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings one after the other, from (length, crc32) of each.

    crc32 is linear: what follows acts on the first part's sum as that many zero bytes would.
    """
    total = 0
    for i, (length, crc) in enumerate(parts):
        if i:
            zeros = bytes(min(length, 1 << 20))
            plain, left = 0, length
            while left:
                step = zeros[:left]
                total, plain = zlib.crc32(step, total), zlib.crc32(step, plain)
                left -= len(step)
            total ^= plain ^ crc
        else:
            total = crc
    return total
