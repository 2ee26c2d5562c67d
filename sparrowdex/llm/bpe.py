"""Byte-pair encoding by rank-synchronous array merging.

Pre-tokens are held together as one ragged numpy array.  In each round every
sequence finds its lowest-rank pair and merges all its occurrences at once (of
overlapping ones, every second from the left); sequences without a pair leave the
arrays.  A merged symbol is never part of a pair of lower rank than the merge that
made it, so a round does what one-by-one merging does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from . import common as C

#: Texts without such characters are split by our own rule; others by the library's pre-tokenizer.
_UNUSUAL = re.compile("[^\x00-\x1b -ɏ‐-‧€]")
_TOP = 0x2100
#: 0 white space, 1 letters, 2 numbers, 3 others, 4 what stands between texts.
_KIND = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(_TOP)], np.uint8)
_KIND[[*range(9, 14), 32, 0x85, 0xA0]] = 0
_KIND[0x1C] = 4
_CODE = np.random.Generator(np.random.PCG64(31337)).integers(1, 1 << 63, _TOP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# The endings that an apostrophe takes along.
_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_TWO = np.array([ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")], np.uint32)
_WINDOW = 500_000
_CUT = re.compile("(?<=[a-zA-Z])(?= )")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class RankBPE:
    """The model of a tokenizers JSON file of byte-level BPE, with its pre-tokenization, held as arrays."""

    LIMIT = 1_000_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + self.suffix] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs, self.new = _Index(len(code)), np.append(new, -1)
        self.pairs.add(code.view(np.uint64))  # a pair's number is its rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.lower = bool(self.suffix)
        self.library = Tokenizer.from_file(path)
        self.words = _Index(self.LIMIT)
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty) one after the other, and how many each piece has."""
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.first[raw]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        seg = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_seg = [], []
        never = np.int64(1) << 40
        while len(ids):
            rank = np.full(len(ids), never)
            pair = np.flatnonzero(seg[1:] == seg[:-1])
            found = self.pairs.find((ids[pair] << 20 | ids[pair + 1]).view(np.uint64))
            rank[pair] = np.where(found < 0, never, found)
            start = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
            length = np.diff(np.concatenate([start, [len(ids)]]))
            low = np.repeat(np.minimum.reduceat(rank, start), length)
            over = low == never
            if over.any():
                done_ids.append(ids[over])
                done_seg.append(seg[over])
            act = ~over & (rank == low)
            run = act & ~np.concatenate([[False], act[:-1]])
            index = np.arange(len(ids))
            since = index - np.maximum.accumulate(np.where(run, index, 0))
            act &= since % 2 == 0
            ids = np.where(act, self.new[np.where(act, rank, -1)], ids)
            keep = ~over & ~np.concatenate([[False], act[:-1]])
            ids, seg = ids[keep], seg[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        seg = np.concatenate(done_seg) if done_seg else np.zeros(0, np.int64)
        return ids[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(pieces))

    def pieces(self, text: str) -> list[bytes]:
        """Pre-tokens by the library, of a text without special strings."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        get = _char_bytes()
        return [bytes(get[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p]

    def encode_apart(self, text: str) -> np.ndarray:
        """Ids of one text with special strings or unusual characters in it."""
        parts: list[np.ndarray] = []
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            parts += [self.merge(self.pieces(text[at : m.start()]))[0], np.array([self.special[m[0]]], np.int64)]
            at = m.end()
        return np.concatenate([*parts, self.merge(self.pieces(text[at:]))[0]])

    def _boundaries(self, cp: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in code points; texts are held apart by a separator, which is a piece of its own."""
        kind = _KIND[cp]
        n = len(cp)
        start = np.ones(n + 3, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[1:n] |= kind[1:] == 4
        quote = np.flatnonzero(cp == 39)
        free = (quote == 0) | (kind[quote - 1] != 3)
        if self.suffix:
            start[:n] |= kind == 2  # each number character by itself
        else:
            last = np.flatnonzero((kind[:-1] == 0) & ((kind[1:] > 0) & (kind[1:] < 4)))
            start[last] = True
            start[last[cp[last] == 32] + 1] = False
            free &= (quote == 0) | (cp[quote - 1] != 32)
        quote = quote[free]
        if len(quote):
            after = np.zeros(n + 2, np.uint32)
            after[:n] = cp
            one, two = after[quote + 1], after[quote + 1] << 16 | after[quote + 2]
            size = np.where(np.isin(one, _ONE), 1, np.where(np.isin(two, _TWO), 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            start[quote + 1 + size] = True
        return np.flatnonzero(start[:n])

    def _known(self, key: np.ndarray, first: np.ndarray, end: np.ndarray, text: str) -> np.ndarray:
        """Entries of the store for distinct words, by their hashes; new words are merged and filed."""
        entry = self.words.find(key)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.words.used + len(new) > self.LIMIT:
                self.words = _Index(self.LIMIT)
                self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
                return self._known(key, first, end, text)
            ids, size = self.merge([text[a:b].encode() for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)])
            entry[new] = self.words.used + np.arange(len(new))
            self.words.add(key[new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return entry

    def _together(self, texts: list[str], with_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        text = "\x1c".join([*texts, ""])
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = self._boundaries(cp)
        end = np.append(first[1:], len(cp))
        up, down = C._powers(len(cp))
        with np.errstate(over="ignore"):
            h = np.cumsum(_CODE[cp] * up[: len(cp)], dtype=np.uint64)
            before = np.where(first > 0, h[first - 1], np.uint64(0))
            key = C.mix((h[end - 1] - before) * down[first] + (end - first).astype(np.uint64))
        kind = _KIND[cp[first]]
        keep = kind != 4
        if self.suffix:
            keep &= kind != 0
        doc = np.cumsum(kind == 4)[keep]
        key, first, end = key[keep], first[keep], end[keep]
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        entry = self._known(distinct, first[at], end[at], text)[back]
        size = self.size[entry]
        n = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        if not with_ids:
            return None, n
        begin = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[entry] - begin, size) + np.arange(int(size.sum()))], n

    def encode(self, texts: list[str], with_ids: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text (an empty list without ``with_ids``) and how many there are."""
        n = np.zeros(len(texts), np.int64)
        out: list = [np.zeros(0, np.int32)] * len(texts) if with_ids else []
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                ids, count = self._together([t for _, t in held], with_ids)
                at = 0
                for (i, _), c in zip(held, count.tolist(), strict=True):
                    n[i] += c
                    if with_ids:
                        out[i] = ids[at : at + c] if not len(out[i]) else np.concatenate([out[i], ids[at : at + c]])
                        at += c
            held, size = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            low = t.lower() if self.lower else t
            if _UNUSUAL.search(t) or _UNUSUAL.search(low) or ("<|" in t and self._special and self._special.search(t)):
                ids = self.encode_apart(t)
                n[i] = len(ids)
                if with_ids:
                    out[i] = ids.astype(np.int32)
                continue
            for part in _windows(low):
                held.append((i, part))
                size += len(part) + 1
                if size > _WINDOW:
                    flush()
        flush()
        return out, n


def _windows(text: str) -> list[str]:
    """A long text in parts that end where a letter is followed by a space, which is always between pre-tokens."""
    out, at = [], 0
    while len(text) - at > _WINDOW:
        cut = next((m.start() + 1 for m in _CUT.finditer(text, at + _WINDOW // 2)), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class _Index:
    """A hash table of 64-bit keys in numpy arrays: the key's number in order of filing, -1 for others."""

    def __init__(self, most: int) -> None:
        self.bits = max(4, (2 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        self.used = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int64)
        at, slot = np.arange(len(key)), self._slot(key)
        while len(at):
            value = self.value[slot]
            same = (self.keys[slot] == key[at]) & (value >= 0)
            out[at[same]] = value[same]
            go = ~same & (value >= 0)
            at, slot = at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray) -> None:
        """``key``: distinct keys that are not filed yet."""
        at, slot = np.arange(len(key)), self._slot(key)
        while len(at):
            free = self.value[slot] < 0
            self.value[slot[free]] = self.used + at[free]
            won = free & (self.value[slot] == self.used + at)
            self.keys[slot[won]] = key[at[won]]
            at, slot = at[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        self.used += len(key)


@lru_cache(1)
def _char_bytes() -> dict[str, int]:
    return {c: b for b, c in _byte_chars().items()}


@lru_cache(4)
def load(path: str) -> RankBPE:
    return RankBPE(path)
