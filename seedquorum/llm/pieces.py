"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads each character once; at each position its output links list every piece that ends there, longest first, and each
relaxes the best path to there. In a unigram model a path's score is the sum of its pieces' log-probabilities; the first best, that is
the longest last piece, wins ties, and a character that no piece covers costs ten more than the worst score. In a BPE model scores are
merge ranks, which don't add up: there a path scores 0 if merging leaves each two neighbours of it as they are, else minus infinity.
Merging ends in such a path, and at every position just one path is admissible, so the ids are the library's. Characters without a piece
become their bytes (or the unknown id). Where no piece holds a word mark after another character, words are independent and go through a
bounded cache; else texts are read whole.

Defined cases: null and empty texts have no ids and decode to the empty text; ids decode to the text with U+2581 read as a space;
null ids and ids beyond the vocabulary decode as the unknown piece; repeated rows are encoded each; an empty table gives an empty result;
texts of any length are encoded whole; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.llm import tokens
from seedquorum.plans.shipping import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
BPE = 2
#: Remembered words.
WORDS = 400_000
#: Remembered pairs of neighbours; beyond it they are worked out anew.
PAIRS = 500_000


def _fields(raw: bytes):
    """(number, value) of a protobuf message: ints, 32-bit values as bytes, and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


class Model:
    """A model file's pieces and normalizer flags."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.squeeze, self.escape, self.kind = True, True, True, 1
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                n = dict(_fields(value))
                if n.get(2):
                    raise ValueError("only identity normalization is supported")
                self.dummy_prefix, self.squeeze, self.escape = (bool(n.get(k, 1)) for k in (3, 4, 5))
        if self.kind == BPE and any(p[2] in (USER, UNUSED) for p in self.pieces):
            raise ValueError("a BPE model with user-defined or unused pieces isn't supported")
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Viterbi:
    """Encodes normalized text with one automaton."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        worst = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        self.unknown_score, self.single = worst - UNKNOWN_COST, set()
        for i, (piece, score, kind) in enumerate(model.pieces):
            if kind in (NORMAL, USER) and piece:
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in model.pieces if k in (NORMAL, USER))

    def encode(self, text: str) -> list[int]:
        n = len(text)
        best: list[float] = [0.0] * (n + 1)
        back: list[int] = [0] * (n + 1)
        piece: list[int] = [-1] * (n + 1)
        least, at = float("-inf"), 0
        best[1:] = [least] * n

        def close(end: int) -> None:
            """Positions up to ``end`` have all their pieces: a lone character may stand where it is no piece."""
            nonlocal at
            while at < end:
                at += 1
                if text[at - 1] not in self.single and (s := best[at - 1] + self.unknown_score) > best[at]:
                    best[at], back[at], piece[at] = s, at - 1, -1

        for last, (size, score, i) in self.automaton.iter(text) if len(self.automaton) else ():
            end = last + 1
            if end - 1 > at:
                close(end - 1)
            start = end - size
            s = best[start] + score
            if s > best[end]:
                best[end], back[end], piece[end] = s, start, i
        close(n)
        found, e = [], n
        while e:
            found.append(piece[e] if piece[e] >= 0 else text[back[e]])
            e = back[e]
        return _ids(self.model, reversed(found))


def _ids(model: Model, found: Iterable[int | str]) -> list[int]:
    """Ids of a path's pieces; a character without a piece is given as itself."""
    out: list[int] = []
    for x in found:
        if not isinstance(x, str):
            out.append(x)
        elif model.bytes:
            out += [model.bytes[b] for b in x.encode()]
        elif not out or out[-1] != model.unknown:
            out.append(model.unknown)
    return out


class Merging:
    """Encodes normalized text of a BPE model by the path whose neighbours merging leaves as they are.

    A path's last item is a piece's id, or minus two minus the code point for a character without a piece.
    """

    START = -1

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        self.score = {p: s for p, s, k in model.pieces if k == NORMAL and p}
        self.size = [len(p) for p, _, _ in model.pieces]
        for i, (piece, _, kind) in enumerate(model.pieces):
            if kind == NORMAL and piece:
                self.automaton.add_word(piece, (len(piece), i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.known: dict[int, bool] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.timely: dict[str, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, float]] | None] = {}

    def merge(self, text: str, made: list[tuple[str, str]] | None = None) -> list[str]:
        """Merging as such: the best-scored pair first, then the leftmost; ``made`` receives the pairs."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(part) and (s := self.score.get(whole := part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, whole))

        for i in range(len(part)):
            offer(i)
        while queue:
            _, i, j, whole = heapq.heappop(queue)
            if part[i] and part[j] and after[i] == j and part[i] + part[j] == whole:
                if made is not None:
                    made.append((part[i], part[j]))
                part[i], part[j], after[i] = whole, "", after[j]
                if after[j] < len(part):
                    before[after[j]] = i
                offer(before[i])
                offer(i)
        return [p for p in part if p]

    def _name(self, item: int) -> str:
        return self.model.pieces[item][0] if item >= 0 else chr(-2 - item)

    def _tree(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; the piece itself and nothing for a character; None if merging doesn't make the piece."""
        if piece not in self.parts:
            self.parts[piece] = (piece, "") if len(piece) == 1 else self._halves(piece)
        return self.parts[piece]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        made: list[tuple[str, str]] = []
        return made[-1] if self.merge(piece, made) == [piece] else None

    def _timely(self, piece: str) -> bool:
        """Whether all parts of a piece are ranked before what they become."""
        if len(piece) == 1:
            return True
        if piece not in self.timely:
            halves = self._tree(piece)
            self.timely[piece] = halves is not None and all(self._timely(t) and (len(t) == 1 or self.score[t] > self.score[piece]) for t in halves)
        return self.timely[piece]

    def _edge(self, item: int, side: int) -> list[tuple[str, float]] | None:
        """What stands at an item's edge while it is merged, from its character on, with the rank at which each goes; None where a part
        is ranked after its whole, as time isn't rank there."""
        if (item, side) not in self.edges:
            out, whole, end = [], self._name(item), math.inf
            while True:
                tree = self._tree(whole)
                if tree is None:
                    out = None
                    break
                out.append((whole, end))
                if not tree[1]:
                    out.reverse()
                    break
                if not self._timely(whole):
                    out = None
                    break
                end, whole = -self.score[whole], tree[side]
            self.edges[item, side] = out
        return self.edges[item, side]

    def _stay(self, left: int, right: int, key: int) -> bool:
        """Whether merging leaves the two as neighbours; from the start, whether it makes the one."""
        if len(self.known) >= PAIRS:
            self.known.clear()
            self.parts.clear()
            self.timely.clear()
            self.edges.clear()
        if left == self.START:
            found = self._tree(self._name(right)) is not None
        elif (a := self._edge(left, 1)) is None or (b := self._edge(right, 0)) is None:
            found = self.merge(self._name(left) + self._name(right)) == [self._name(left), self._name(right)]
        else:  # the earliest of three: the left edge goes, the two edges merge, the right edge goes; a tie goes to the leftmost
            i, j, found = 0, 0, True
            while True:
                (x, gone_x), (y, gone_y) = a[i], b[j]
                rank = -self.score.get(x + y, -math.inf)
                if rank < gone_x and rank <= gone_y:
                    found = False
                    break
                if gone_x <= gone_y:
                    if gone_x == math.inf:
                        break
                    i += 1
                else:
                    j += 1
        self.known[key] = found
        return found

    def encode(self, text: str) -> list[int]:
        n, at, known, single = len(text), 0, self.known, self.score
        last: list[int | None] = [None] * (n + 1)
        last[0] = self.START

        def close(start: int, end: int) -> bool:
            """Positions up to ``end`` have all their pieces: a lone character may stand where no piece does."""
            for p in range(start + 1, end + 1):
                if last[p] is None:
                    if text[p - 1] in single:
                        return False
                    item = -2 - ord(text[p - 1])
                    if not self._stay(last[p - 1], item, (last[p - 1] << 22) + item):
                        return False
                    last[p] = item
            return True

        for stop, (size, item) in self.automaton.iter(text) if len(self.automaton) else ():
            if stop > at:
                if (last[stop] is None or stop > at + 1) and not close(at, stop):
                    break
                at = stop
            end = stop + 1
            if last[end] is None:
                left = last[end - size]
                key = (left << 22) + item
                stays = known.get(key)
                if self._stay(left, item, key) if stays is None else stays:
                    last[end] = item
        whole = True
        if close(at, n):
            found: list[int | str] = []
            e, size_of = n, self.size
            while e:
                item = last[e]
                if item >= 0:
                    found.append(item)
                    e -= size_of[item]
                else:
                    e -= 1
                    found.append(text[e])
                    whole = False
            found.reverse()
            if whole:
                return found
        else:  # equal merge scores may leave a position without a path
            number = {p: i for i, (p, _, k) in enumerate(self.model.pieces) if k == NORMAL}
            found = [number.get(p, p) for p in self.merge(text)]
        return _ids(self.model, found)


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        self.viterbi = Merging(self.model) if self.model.kind == BPE else Viterbi(self.model)
        self.cache = tokens.WordCache(lambda new: map(self.viterbi.encode, new), WORDS)
        raw = []
        for p, _, kind in self.model.pieces:
            raw.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNUSED) else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        # a line end that no longer piece holds parts words too (unknown characters in a row are one id, unless they become bytes)
        alone = "\n" if self.model.bytes and not any("\n" in p and len(p) > 1 for p, _, kind in self.model.pieces if kind in (NORMAL, USER)) else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's count."""
        words, per = [], []
        for t in texts:
            t = self.model.normalize(t or "")
            w = [t] if t and self.viterbi.crossing else self.words.findall(t)
            words += w
            per.append(len(w))
        ids, size = self.cache.ids(self.cache.look_up(words))
        ends = np.append(0, np.cumsum(size))
        cut = np.append(0, np.cumsum(per))
        return ids, ends[cut[1:]] - ends[cut[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes in a row and their offsets; a dummy prefix's space goes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.raw[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)]
        offs = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        if self.model.dummy_prefix:
            first = offs[:-1][(offs[1:] > offs[:-1])]
            first = first[out[first] == 32]
            keep = np.ones(total, bool)
            keep[first] = False
            gone = np.append(0, np.cumsum(~keep))
            out, offs = out[keep], offs - gone[offs]
        return out, offs


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_ok): ids of whole texts; decoded_ok says that they decode to the text."""
    ship(docs.sparkSession)

    def run(batches):
        own = codec(path)
        for whole in batches:
            for batch in tokens.slices(whole, 256):
                ids, n = own.encode(batch.column("text").to_pylist())
                data, offs = own.decode(ids, n)
                want, at = T.flat(batch.column("text"))
                ok = [len(w) == e - s and bool((w == data[s:e]).all()) for s, e, w in ((offs[i], offs[i + 1], want[at[i] : at[i + 1]]) for i in range(len(n)))]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), lists, pa.array(ok, pa.bool_())], ["doc_id", "n_pieces", "ids", "decoded_ok"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.released(run), "doc_id long, n_pieces long, ids array<int>, decoded_ok boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches):
        own = codec(path)
        for whole in batches:
            for batch in tokens.slices(whole, 256):
                lists = batch.column("ids").to_pylist()
                n = np.array([len(x or ()) for x in lists], np.int64)
                ids = np.array([own.model.unknown if i is None else i for x in lists for i in x or ()], np.int64)
                ids[(ids < 0) | (ids >= len(own.size))] = own.model.unknown
                data, offs = own.decode(ids, n)
                texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(T.released(run), "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or tokens.default_path("piece_bpe_32k.model"))
