"""Token ids of whole texts with a public vocabulary, many texts at a time.

The vocabulary `word_bpe_49k.json` lower-cases, drops white space and merges only
inside pieces: runs of letters, single digits, runs of other signs, and a few
endings after an apostrophe. A piece's ids therefore depend on the piece alone. A
batch of texts is cut into pieces with numpy, each piece the worker hasn't met
yet goes through the tokenizers library once, and ids are gathered by piece.
Texts for which cutting is not that plain (code points outside the first plane,
case or normal forms that change a text's length, strings of special tokens) go
through the library whole.

The worker's memory of pieces is bounded by ``PIECES``; when it is full it starts
anew. Batches are bounded by ``BATCH_CHARS`` (a longer text is cut at white space).
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import numpy as np
from tokenizers import Tokenizer

BATCH_CHARS = 500_000
PIECES = 500_000
# The endings which the vocabulary's pattern cuts off after an apostrophe, in its order.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACE, LETTER, NUMBER, OTHER = range(4)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def plane_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and class of each code point of the first plane; class 255: not plain."""
    lower = np.arange(0x10000, dtype=np.uint32)
    kind = np.full(0x10000, OTHER, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        low = ch.lower()
        if 0xD800 <= c < 0xE000 or len(low) != 1 or unicodedata.normalize("NFC", ch) != ch or unicodedata.combining(ch):
            kind[c] = 255
            continue
        lower[c] = ord(low)
        group = unicodedata.category(low)
        if c < 0x20 or group.startswith("Z") or c == 0x85:
            kind[c] = SPACE if c in (9, 10, 11, 12, 13, 0x85) or group.startswith("Z") else OTHER
        elif group.startswith("L"):
            kind[c] = LETTER
        elif group.startswith("N"):
            kind[c] = NUMBER
        elif group == "Cn":
            kind[c] = 255
    kind[0x1100:0x1200] = 255  # parts of Korean syllables, which the normal form puts together
    return lower, kind


class Pieces:
    """Encodes lists of texts; one per worker and vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        self.whole = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        # one piece at a time: no normal form, no cutting
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.single = Tokenizer.from_str(json.dumps(spec))
        self.lower, self.kind = plane_tables()
        n = BATCH_CHARS + 1
        self.power, self.back = powers(BASE, n), powers(inverse(BASE), n)
        self.power2, self.back2 = powers(BASE2, n), powers(inverse(BASE2), n)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted, and for each the entry it has
        self.entry = np.zeros(0, dtype=np.int64)
        self.checks, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, as the library gives them for it; null: none."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if len(text) > BATCH_CHARS and (end := max(text.rfind(" ", 1, BATCH_CHARS), text.rfind("\n", 1, BATCH_CHARS))) > 0:
                out[i] = np.concatenate([part for half in (text[:end], text[end:]) for part in self.encode([half])])
                continue
            if not text.isascii() and not unicodedata.is_normalized("NFC", text) or "<|" in text and any(s in text for s in SPECIAL) or len(text) > BATCH_CHARS:
                out[i] = self.by_library(text)
                continue
            if chars + len(text) + 1 > BATCH_CHARS and plain:
                self.batch(texts, plain, out)
                plain, chars = [], 0
            plain.append(i)
            chars += len(text) + 1
        if plain:
            self.batch(texts, plain, out)
        return out

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def batch(self, texts: list[str], chosen: list[int], out: list) -> None:
        points = np.frombuffer("\n".join([texts[i] for i in chosen]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(texts[i]) + 1 for i in chosen])
        low = np.minimum(points, 0xFFFF)
        kind = self.kind[low]
        odd = (kind == 255) | (points > 0xFFFF)
        if odd.any():
            bad = set(np.searchsorted(ends, np.flatnonzero(odd), side="right").tolist())
            for b in bad:
                out[chosen[b]] = self.by_library(texts[chosen[b]])
            left = [c for b, c in enumerate(chosen) if b not in bad]
            if left:
                self.batch(texts, left, out)
            return
        starts, stops, low = self.cut(self.lower[low], kind)
        if not len(starts):
            for c in chosen:
                out[c] = np.zeros(0, dtype=np.uint32)
            return
        hashes, checks, first, which = self.distinct(low, starts, stops)
        entry = self.entries(low, starts[first], stops[first], hashes, checks)[which]
        sizes = self.size[entry]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.at[entry] - total[:-1], sizes) + np.arange(total[-1])]
        edge = total[np.searchsorted(starts, ends)]
        for c, part in zip(chosen, np.split(ids, edge[:-1])):
            out[c] = part

    def cut(self, low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start and stop."""
        n = len(low)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), low
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero(low == 0x27)
        for q in quotes[new[quotes]]:
            if q + 1 < n and kind[q + 1] == LETTER and new[q + 1]:
                rest = "".join(map(chr, low[q + 1 : q + 3]))
                end = next((e for e in ENDINGS if rest.startswith(e)), None)
                if end:
                    new[q + 1] = False
                    if q + 1 + len(end) < n:
                        new[q + 1 + len(end)] = True
        edges = np.flatnonzero(new)
        starts, stops = edges[:-1], edges[1:]
        real = kind[starts] != SPACE
        return starts[real], stops[real], low

    def distinct(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct pieces (hash, second hash, first place), sorted by hash, and for each piece which of them it is."""

        def hashes(power, back):
            run = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=run[1:])
            return (run[stops] - run[starts]) * back[starts]

        one, two = hashes(self.power, self.back), hashes(self.power2, self.back2)
        found, first, which = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first][which]).any():  # equal hashes of unequal pieces: tell them apart by both
            both, first, which = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
            return both[:, 0], both[:, 1], first, which.reshape(-1)
        return found, two[first], first, which

    def entries(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of the distinct pieces in this worker's memory; pieces not met yet go through the library."""
        if len(self.at) > PIECES:
            self.clear()
        entry = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = (self.hashes[near] == hashes) & (self.checks[self.entry[near]] == checks)
            entry[same] = self.entry[near[same]]
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            text = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            pieces = [text[x:y] for x, y in zip(starts[missing].tolist(), stops[missing].tolist())]
            ids = [e.ids for e in self.single.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            have, total = self.used, self.used + int(sizes.sum())
            if total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(total, dtype=np.uint32)])
            self.ids[have:total] = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=total - have)
            place = np.arange(len(self.at), len(self.at) + len(ids))
            self.at = np.concatenate([self.at, have + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.checks = np.concatenate([self.checks, checks[missing]])
            self.used = total
            entry[missing] = place
            new = np.searchsorted(self.hashes, hashes[missing])
            self.hashes, self.entry = np.insert(self.hashes, new, hashes[missing]), np.insert(self.entry, new, place)
        return entry


_workers: dict[str, Pieces] = {}


def encoder(vocabulary: str) -> Pieces:
    if vocabulary not in _workers:
        _workers[vocabulary] = Pieces(vocabulary)
    return _workers[vocabulary]
