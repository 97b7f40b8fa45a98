"""Encoding whole texts with the tokenizers library, each distinct unit of a slice of text once.

A byte-level BPE splits text before merging, so a text's ids are the ids of its units wherever every cut between units is also one of
the split's. Sure cuts, found in the bytes: before a single space, around a single line feed, and before an ASCII character that isn't a
letter but follows an ASCII letter. Arrow collects a slice's distinct units, the library encodes them joined in a few calls, and NumPy deals
their ids out. Nothing is kept from slice to slice, so a worker's memory doesn't grow with what it has read. Texts where the argument
doesn't hold (white space beside white space, a special token's string) are one unit each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from seedquorum.llm import text as T

SLICE = 8 << 20
CALL = 2000
CACHE_WORDS = 200_000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Ids of words in one pool of numbers; a word costs a dictionary look-up. Full at ``limit`` words, it keeps those seen again."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], limit: int = CACHE_WORDS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.start, self.size, self.hits = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _put(self, new: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n, total = len(self.number), len(flat)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(new) > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        self.pool[self.used : self.used + total] = flat
        self.size[n : n + len(new)] = size
        self.start[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.used += total
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def _shrink(self) -> None:
        """Keeps at most half: the words looked up most since the last time."""
        words, hits = list(self.number), self.hits[: len(self.number)]
        floor = max(2, int(np.partition(hits, len(hits) // 2)[len(hits) // 2]) + 1)
        keep = np.flatnonzero(hits >= floor)
        flat, size = self.ids(keep)
        self.clear()
        self._put([words[k] for k in keep], flat, size)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Numbers of words, good until the next call; new ones are encoded."""
        if len(self.number) > self.limit:
            self._shrink()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            absent = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(absent))
            ids = list(self.encode(new))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(new, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size)
            found[missing] = list(map(self.number.__getitem__, absent))
        self.hits += np.bincount(found, minlength=len(self.hits))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and the count of each word."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[numbers] - ends + size, size) + np.arange(total)], size


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: ASCII white space of either Python or the library's pattern.
_WHITE = _table((9, 13), (28, 32))
_ASCII, _LETTER = _table((0, 127)), _table((65, 90), (97, 122))
#: Bytes of letters up to U+027F, where all from U+00C0 are letters but two signs.
_LATIN = _LETTER | _table((0x80, 0xBF), (0xC3, 0xC9))
_SIGNS = ("\u00d7".encode()[1], "\u00f7".encode()[1])
#: Other white space, by first byte.
_FAR = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_FAR_FIRST = _table(*((c[0], c[0]) for c in _FAR))


def _byte_letters() -> np.ndarray:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[own] = own
    rest = np.setdiff1d(np.arange(256), own)
    out[rest] = 256 + np.arange(len(rest))
    return out


def _beside(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether ASCII white space stands before or after each place."""
    before, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + size, len(data) - 1)]
    return _WHITE[before] | _WHITE[after]


class Encoder:
    """Encodes columns of texts; ``end_id`` is appended to each."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.special = [t["content"].encode() for t in settings.get("added_tokens", ())]
        pre, bpe = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
        self.letters = _byte_letters()
        space, feed = chr(self.letters[32]), chr(self.letters[10])
        vocabulary = self.library.get_vocab()
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not settings.get("normalizer") and bpe.get("type", "BPE") == "BPE" and not bpe.get("dropout")
        self.by_unit = self.by_unit and feed in vocabulary and not any(set(s) & {32, 10} for s in self.special)
        self.feed, self.leads = vocabulary.get(feed, -1), np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for p, i in vocabulary.items() if p.startswith(space)]] = True
        # the same model, for units that are one part: text already in byte letters, cut before each space letter
        self.parts = Tokenizer(self.library.model)
        self.parts.pre_tokenizer = pre_tokenizers.Split(space, "merged_with_next")

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _irregular(self, data: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows that have to go to the library whole."""
        if not self.by_unit:
            return np.diff(b) > 0
        full = np.flatnonzero(np.diff(b))
        ends = np.concatenate([b[full], b[full + 1] - 1])
        space = np.flatnonzero(data == 32)
        at = [ends[_WHITE[data[ends]]], space[_beside(data, space, 1)]]
        maybe = np.flatnonzero(_FAR_FIRST[data])
        if len(maybe):
            pad = np.append(data, np.zeros(3, np.uint8))
            for c in _FAR:
                found = maybe[np.logical_and.reduce([pad[maybe + k] == x for k, x in enumerate(c)])]
                edge = np.isin(found, b) | np.isin(found + len(c), b)
                at.append(found[edge | _beside(data, found, len(c))])
        raw = None
        for s in self.special:
            raw = data.tobytes() if raw is None else raw
            k = raw.find(s)
            while k >= 0:
                at.append(np.array([k, k + len(s) - 1]))
                k = raw.find(s, k + 1)
        out = np.zeros(len(b) - 1, bool)
        out[np.searchsorted(b, np.concatenate(at), "right") - 1] = True
        return out

    def _joined(self, tokenizer, texts: Iterable[str], counts: list[int], marks: Callable[[np.ndarray], np.ndarray], between: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and sizes of units from joined texts; ``marks`` are the first ids of units, or the ids between them."""
        sizes, pools = [], []
        for text, n in zip(texts, counts, strict=True):
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(marks(ids))
            if len(at) + between != n:
                raise ValueError("units and ids don't agree")
            sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1 if between else np.diff(np.append(at, len(ids))))
            pools.append(np.delete(ids, at) if between else ids)
        return pools, sizes

    def _units(self, units: pa.Array, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, and each distinct unit's start and size in it; ``alone``: units not to be joined."""
        data, offs = T.flat(units)
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        first = offs[:-1]
        led = data[first] == 32
        white = _WHITE[data]
        white[first[led]] = False
        alone = alone | (np.add.reduceat(white, first, dtype=np.int64) > 0)
        odd = ~_LATIN[data]
        odd[first[led]] = False
        lead = np.flatnonzero(data[:-1] == 0xC3)
        odd[lead] |= np.isin(data[lead + 1], _SIGNS)
        odd = np.add.reduceat(odd, first, dtype=np.int64) > 0
        order, sizes, pools = [], [], []

        def steps(who: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
            order.append(who)
            d, o = T.flat(units.take(pa.array(who)))
            return d, o, [(int(k), min(int(k) + CALL, len(who))) for k in range(0, len(who), CALL)]

        d, o, at = steps(np.flatnonzero(led & ~odd & ~alone))  # a space and letters: one part
        d = self.letters[d]
        got = [self._joined(self.parts, (d[o[x] : o[y]].tobytes().decode("utf-16-le") for x, y in at), [y - x for x, y in at], self.leads.__getitem__, False)]
        d, o, at = steps(np.flatnonzero(led & odd & ~alone))
        got.append(self._joined(self.library, (d[o[x] : o[y]].tobytes().decode() for x, y in at), [y - x for x, y in at], self.leads.__getitem__, False))
        d, o, at = steps(np.flatnonzero(~led & ~alone))
        got.append(self._joined(self.library, ("\n".join(d[o[k] : o[k + 1]].tobytes().decode() for k in range(x, y)) for x, y in at), [y - x for x, y in at], lambda ids: ids == self.feed, True))
        for p, s in got:
            pools += p
            sizes += s
        who = np.flatnonzero(alone)
        order.append(who)
        for k in range(0, len(who), 256):
            each = [e.ids for e in self.library.encode_batch_fast(units.take(pa.array(who[k : k + 256])).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            pools.append(np.fromiter(chain.from_iterable(each), np.int32, int(sizes[-1].sum())))
        order, placed = np.concatenate(order), np.concatenate(sizes)
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        size[order], start[order] = placed, np.cumsum(placed) - placed
        return np.concatenate(pools), start, size

    def _slice(self, data: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids in a row, each row's end id included, and each row's count."""
        n = len(b) - 1
        if not len(data):
            return np.full(n, self.end_id, np.int32), np.ones(n, np.int64)
        whole = self._irregular(data, b)
        before = np.append(np.uint8(32), data[:-1])
        cut = (data == 32) | _LETTER[before] & _ASCII[data] & ~_LETTER[data]
        feed = (data == 10) & ~_WHITE[before]
        feed[:-1] &= ~_WHITE[data[1:]]
        cut |= feed
        cut[1:] |= feed[:-1]
        for r in np.flatnonzero(whole):
            cut[b[r] : b[r + 1]] = False
        cut[b[:-1][np.diff(b) > 0]] = True
        offs = np.append(np.flatnonzero(cut), len(data))
        found = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which = found.indices.to_numpy()
        alone = np.zeros(len(found.dictionary), bool)
        alone[which[np.searchsorted(offs, b[:-1][whole])]] = True
        pool, start, size = self._units(found.dictionary, alone)
        each = size[which]
        ends = np.append(0, np.cumsum(each))
        row_ends = ends[np.searchsorted(offs, b)]
        counts = np.diff(row_ends) + 1
        out = np.full(int(ends[-1]) + n, self.end_id, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts) - 1] = False
        small = np.int32 if max(len(pool), len(out)) < 1 << 31 else np.int64
        out[keep] = pool[np.repeat((start[which] - ends[:-1]).astype(small), each) + np.arange(ends[-1], dtype=small)]
        return out, counts

    def slices(self, column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, counts) of about ``limit`` bytes of text each; null counts as empty."""
        data, offs = T.flat(column)
        for i, j in T.blocks(offs, limit):
            yield i, j, *self._slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, the end id after each text, and each text's count."""
        got = [(ids, n) for _, _, ids, n in self.slices(pa.array(texts, pa.large_string()))]
        return (np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])) if got else (np.zeros(0, np.int32), np.zeros(0, np.int64))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker process: the vocabulary alone is kept."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def slices(batch: pa.RecordBatch, rows: int = 512):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
