"""Exact removal of repeated passages by a hash-compared suffix sort over sparse suffixes.

A passage is a window of units: of bytes (``BYTES``, 400 of them) or of words with any white space between (``WORDS``, 51 of them). One
that starts at two places is found without touching every pair of positions:

1. anchors   each window picks the smallest hash of a gram (64 bytes, 8 words) inside it (the rightmost of ties), which depends on
             the window alone. Neighbouring windows with one anchor form a segment; about 6 segments a KB.
2. collapse  segments whose anchor occurs once can't repeat. Equal segments are counted by digest, with map-side
             partial sums, so a passage that a third of the rows share is one variant with a count.
3. sort      variants that aren't found to repeat yet, beside others of the same anchor, fetch their text. Per anchor the suffixes right
             of the anchor, and the reversed prefixes left of it, are merge-sorted; comparisons find common extensions by binary search
             on prefix polynomial hashes (logarithmic), and the neighbours' extensions are verified unit by unit. A window at
             offset o repeats exactly when another variant shares its class of ``length - o`` units right and o units left.
4. cut       per document the windows' union is removed.

Joins on the anchor are between written tables, so a hot anchor's rows can be split. An anchor with more than ``HOT`` variants isn't
gathered: the 128-bit digests of its windows are counted by a grouped aggregate instead.

``across``: only windows that another document has too, where rows of one doc_id are one document.

Defined cases: null texts are empty; texts shorter than a window lose nothing; every copy of a repeated passage goes, the
first included; repeated rows are copies of each other; null doc_ids are rows of one document like any other id; an empty table
gives an empty result; a text of any length is searched whole, in the task that reads it; further columns aren't read and may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.plans.workspace import Workspace

LENGTH = 400
HOT = 4096
#: Variants sorted together, or a whole anchor.
TOGETHER = 6000
_CHUNK = 1_000_000
_LOW = np.uint64((1 << 20) - 1)
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Kind:
    """What a passage is made of: its unit, how many make one, how many make a gram; whether it has to be in another document."""

    words: bool = False
    length: int = LENGTH
    gram: int = 64
    across: bool = False

    def values(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash values of the units, their starts and ends in ``data``, and the rows' bounds in units."""
        if self.words:
            h, start, end, at = T.exact_words(data, bounds)
            return h, start, end, at
        place = np.arange(len(data) + 1)
        return T.BYTE_VALUE[data], place[:-1], place[1:], bounds

    def ends(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of one text's units."""
        data = np.frombuffer(raw, np.uint8)
        if self.words:
            return T.runs(~T.IS_SPACE[data], np.array([0, len(data)]))
        place = np.arange(len(data) + 1)
        return place[:-1], place[1:]

    def symbols(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact numbers of the units of all strings in a row, values to hash them by, and each string's count."""
        if self.words:
            each = [s.split() for s in strings]
            found = pa.array([w for ws in each for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            return found, T.mix(found.astype(np.uint64) * np.uint64(T.RADIX) + np.uint64(7)) | np.uint64(1), np.array([len(ws) for ws in each], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        return data, T.BYTE_VALUE[data], np.array([len(s) for s in strings], np.int64)


BYTES = Kind()
#: Passages of over 50 words that another document has too.
WORDS = Kind(True, 51, 8, True)


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(v) - width + 1
    full = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    square = full.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(values: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = BYTES.gram):
    """Segments of rows: first window, last window (positions in values), anchor position, anchor hash."""
    width = length - gram + 1
    valid = np.zeros(len(values) + 1, np.int32)
    long = np.diff(bounds) >= length
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    out = []
    for c in range(0, len(values), _CHUNK):
        part, ok = values[c : c + _CHUNK + length - 1], valid[c : c + _CHUNK]
        if len(part) < length or not ok.any():
            continue
        sums = T.value_sums(part)
        m = len(part) - gram + 1
        h = T.mix((sums[gram:] - sums[:m]) * T.powers(m, "down"))
        low = _window_min((h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64)), width)[:_CHUNK]
        ok = ok[: len(low)]
        at = (_LOW - (low & _LOW)).astype(np.int64)
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        out.append((first + c, last + c, at[first] + c, h[at[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_SEGMENT = "anchor long, digest long, off int, span int, doc long, th long, at int"


def _segments(kind: Kind):
    def run(batches):
        for batch in batches:
            data, offs = T.flat(batch.column("text"))
            ids, th = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            for i, j in T.blocks(offs, 900_000):
                values, _, _, b = kind.values(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                first, last, at, h = segments(values, b, kind.length, kind.gram)
                if not len(first):
                    continue
                raw = memoryview(np.ascontiguousarray(values if kind.words else data[offs[i] : offs[j]])).cast("B")
                size = 8 if kind.words else 1
                digest = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip((first * size).tolist(), ((last + kind.length) * size).tolist(), strict=True)], np.uint64)
                row = np.searchsorted(b, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), pa.array((at - first).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(ids[i + row]), pa.array(th[i + row]), pa.array((first - b[row]).astype(np.int32))],
                    ["anchor", "digest", "off", "span", "doc", "th", "at"],
                )

    return T.released(run)


_KEY = ["anchor", "digest", "off", "span"]
_CUT = "anchor long, digest long, off int, span int, c long, high long, at int, hot boolean, covered boolean, doc long, th long, bytes binary"


def _cut_out(kind: Kind):
    """The bytes of wanted segments of each row's text."""
    names = [*_KEY, "c", "high", "at", "hot", "covered"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def made(out):
        cols = [*zip(*out, strict=True)] if out else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], [*names, "doc", "th", "bytes"])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for text, doc, th, wanted in zip(batch.column("text"), batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("wanted"), strict=True):
                raw = (text.as_py() or "").encode()
                start, end = kind.ends(raw)
                for w in wanted.as_py():
                    piece = raw[start[w["at"]] : end[w["at"] + w["span"] + kind.length - 1]]
                    out.append((*(w[n] for n in names), doc, th, piece))
                    held += len(piece)
                if held > 4_000_000:
                    yield made(out)
                    out, held = [], 0
            yield made(out)

    return T.released(run)


class SuffixSorter:
    """Sorts one suffix (or reversed prefix) per member of each group by hash comparisons.

    ``at``: the position in ``data`` where the suffix starts, or before which the reversed prefix ends; ``size``: its length.
    """

    def __init__(self, data: np.ndarray, sums: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, forward: bool):
        self.data, self.sums, self.at, self.size, self.group, self.forward = data, sums, at, size, group, forward

    def _same(self, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        a0, a1, b0, b1 = (a, a + t, b, b + t) if self.forward else (a - t, a, b - t, b)
        return T.range_hash(self.sums, a0, a1) == T.range_hash(self.sums, b0, b1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that two members have in common, by binary search on hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self._same(i, j, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _byte(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        where = self.at[i] + t if self.forward else self.at[i] - t - 1
        return np.where(t < self.size[i], self.data[np.clip(where, 0, len(self.data) - 1)].astype(np.int64), -1)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self.group[i] < self.group[j]
        own = np.flatnonzero(self.group[i] == self.group[j])
        if len(own):
            a, b = i[own], j[own]
            t = self.extension(a, b)
            x, y = self._byte(a, t), self._byte(b, t)
            out[own] = (x < y) | (x == y) & (a < b)
        return out

    def order(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each element finds its rank in the sibling run by binary search."""
        n, order, width = len(self.at), np.arange(len(self.at)), 1
        place = np.arange(n)
        while width < n:
            run = place // width
            sib = np.where(run % 2 == 0, run + 1, run - 1)
            lo, end = np.minimum(sib * width, n), np.minimum((sib + 1) * width, n)
            start, hi = lo.copy(), end.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                right = self.less(order[mid], order[live])
                lo[live] = np.where(right, mid + 1, lo[live])
                hi[live] = np.where(right, hi[live], mid)
                live = live[lo[live] < hi[live]]
            first = np.minimum(run, sib) * width
            new = np.empty_like(order)
            new[first + (place - run * width) + (lo - start)] = order
            order, width = new, width * 2
        return order

    def sorted_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and for each place the bytes shared with the place before (-1 at a group's first), verified."""
        order = self.order()
        ext = np.full(len(order), -1, np.int64)
        own = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        ext[own] = self.extension(order[own - 1], order[own])
        t = ext[own]
        rep = np.repeat(np.arange(len(own)), t)
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        a, b = self.at[order[own - 1]][rep], self.at[order[own]][rep]
        x, y = (a + step, b + step) if self.forward else (a - 1 - step, b - 1 - step)
        if (self.data[x] != self.data[y]).any():  # two strings of one hash: compare bytes instead
            return self._by_bytes()
        return order, ext

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        def own(i: int) -> list[int]:
            a, n = int(self.at[i]), int(self.size[i])
            return self.data[a : a + n].tolist() if self.forward else self.data[a - n : a][::-1].tolist()

        strings = [own(i) for i in range(len(self.at))]
        order = np.array(sorted(range(len(strings)), key=lambda i: (self.group[i], strings[i], i)), np.int64)
        ext = np.full(len(order), -1, np.int64)
        for k in range(1, len(order)):
            i, j = order[k - 1], order[k]
            if self.group[i] == self.group[j]:
                n = 0
                for p, q in zip(strings[i], strings[j], strict=False):
                    if p != q:
                        break
                    n += 1
                ext[k] = n
        return order, ext


def repeated_windows(strings: list[bytes], group: np.ndarray, off: np.ndarray, span: np.ndarray, low: np.ndarray, high: np.ndarray, kind: Kind = BYTES):
    """(member, window) of windows that another member of the group has at the same offset from its anchor.

    low, high: least and greatest document of each member; with ``kind.across`` a window's members have to be of several.
    """
    data, values, sizes = kind.symbols(strings)
    start = np.cumsum(sizes) - sizes
    sums, at, n = T.value_sums(values), start + off, len(strings)
    right, r_ext = SuffixSorter(data, sums, at, sizes - off, group, True).sorted_extensions()
    left, l_ext = SuffixSorter(data, sums, at, off.astype(np.int64), group, False).sorted_extensions()
    who, window = [], []
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int((off - span).min()), int(off.max()) + 1):
        live = np.flatnonzero((off >= o) & (off - span <= o))
        if len(live) < 2:
            continue
        rc[right] = np.cumsum(r_ext < kind.length - o)
        lc[left] = np.cumsum(l_ext < o)
        key = rc[live] * (n + 1) + lc[live]
        by = np.argsort(key, kind="stable")
        k = key[by]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(first, len(k)))
        good = size > 1
        if kind.across:
            good &= np.minimum.reduceat(low[live[by]], first) < np.maximum.reduceat(high[live[by]], first)
        found = live[by[np.repeat(good, size)]]
        who.append(found)
        window.append(off[found] - o)
    return (np.concatenate(who), np.concatenate(window)) if who else (np.zeros(0, np.int64),) * 2


_MEMBER = "anchor long, digest long, off int, span int, c long, doc long, th long, at int"
_FOUND = f"{_MEMBER}, first int, last int"


def _found(rows: pa.Table, who: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Windows of uncovered members to runs of windows: neighbouring windows of a member make one."""
    open_ = ~rows.column("covered").to_numpy()[who]
    who, window = who[open_], window[open_]
    by = np.lexsort((window, who))
    who, window = who[by], window[by]
    cut = np.ones(len(who), bool)
    cut[1:] = (who[1:] != who[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(who)) - 1 if len(who) else first
    own = rows.select([*_KEY, "c", "doc", "th", "at"]).take(pa.array(who[first]))
    cols = [*(c.combine_chunks() for c in own.columns), pa.array(window[first].astype(np.int32)), pa.array(window[last].astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, [*own.column_names, "first", "last"])


def _sort_variants(kind: Kind):
    """Rows come sorted by anchor; whole anchors are handled together, many at a time."""

    def work(rows: pa.Table):
        anchor, low, high = (rows.column(x).to_numpy() for x in ("anchor", "doc", "high"))
        off, span = (rows.column(x).to_numpy().astype(np.int64) for x in ("off", "span"))
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1])) if len(anchor) else anchor
        return _found(rows, *repeated_windows(rows.column("bytes").to_pylist(), group, off, span, low, high, kind))

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchor = rows.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if cut:
                    yield work(rows.slice(0, cut).combine_chunks())
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return T.released(run)


def _window_digests(kind: Kind):
    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for i, raw in enumerate(batch.column("bytes").to_pylist()):
                units = raw.split() if kind.words else None
                n = (len(units) if kind.words else len(raw)) - kind.length + 1
                d = [xxhash.xxh3_128_intdigest(b" ".join(units[k : k + kind.length]) if kind.words else raw[k : k + kind.length]) for k in range(n)]
                hi, lo = (np.array(x, np.uint64).view(np.int64) for x in ([v >> 64 for v in d], [v & (1 << 64) - 1 for v in d]))
                own = rows.select([*_KEY, "c", "doc", "th", "at", "high", "covered"]).take(pa.array(np.full(n, i)))
                place = pa.array(np.arange(n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), place, place, pa.array(hi), pa.array(lo)], [*own.column_names, "first", "last", "hi", "lo"])

    return T.released(run)


def _merge(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _spans(raw: bytes, ranges: list | None, kind: Kind) -> list[tuple[int, int]]:
    """Byte spans of a text's ranges of units."""
    if not ranges:
        return []
    merged = _merge([(x["start"], x["end"]) for x in ranges])
    if not kind.words:
        return merged
    start, end = kind.ends(raw)
    return [(int(start[s]), int(end[e - 1])) for s, e in merged]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    at, parts = 0, []
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return [*parts, raw[at:]]


def _keep(kind: Kind):
    def run(batches):
        types = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept, spans, n, cut = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                raw = (text.as_py() or "").encode()
                gone = _spans(raw, ranges.as_py(), kind)
                kept.append(b"".join(_without(raw, gone)))
                spans.append([{"start": s, "end": e} for s, e in gone])
                n.append(len(raw))
                cut.append(sum(e - s for s, e in gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, types), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return T.released(run)


@T.released
def _digest(batches):
    """The contract's columns, and the number of longer passages of words."""
    for batch in batches:
        cols = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")}
        for text, ranges, passages in zip(batch.column("text"), batch.column("ranges"), batch.column("passages"), strict=True):
            raw = (text.as_py() or "").encode()
            gone = _spans(raw, ranges.as_py(), BYTES)
            kept, passages = b"".join(_without(raw, gone)), passages.as_py()
            row = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(_merge([(x["start"], x["end"]) for x in passages])) if passages else 0)
            for c, v in zip(cols.values(), row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if n == "kept_sha256" else pa.int64()) for n, v in cols.items())], ["doc_id", *cols])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def repeated_ranges(docs: DataFrame, work: Workspace | None = None, kind: Kind = BYTES) -> DataFrame:
    """(doc, th, ranges): ranges of units (overlapping ones unmerged) that repeat; doc is the id, the least long for null, th xxhash64 of the text."""
    work = work or Workspace(docs.sparkSession, "passages")
    docs = _keyed(docs).drop("doc_id")
    least = 2 * kind.length - 1 if kind.words else kind.length
    found = work.write(docs.where(F.octet_length("text") >= least).mapInArrow(_segments(kind), _SEGMENT), "segments")
    often = work.write(found.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "often")
    found = work.write(found.join(often, "anchor"), "repeated")
    work.drop("segments")
    work.drop("often")
    variants = found.groupBy(*_KEY).agg(F.count("*").alias("c"), F.min(F.struct("doc", "th", "at")).alias("r"), F.max("doc").alias("high"))
    variants = work.write(variants.withColumn("covered", F.expr("r.doc < high" if kind.across else "c > 1")), "variants")
    ranges = found.join(variants.where("covered").select(*_KEY), _KEY).select("doc", "th", F.col("at").alias("start"), (F.col("at") + F.col("span") + kind.length).alias("end"))
    mixed = work.write(variants.groupBy("anchor").agg(F.count("*").alias("nv"), F.bool_or(~F.col("covered")).alias("open")).where("nv > 1 and open").select("anchor", (F.col("nv") > HOT).alias("hot")), "mixed")
    wanted = variants.join(mixed, "anchor").select("r.*", *_KEY, "c", "high", "hot", "covered")
    wanted = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct(*_KEY, "c", "high", "at", "hot", "covered")).alias("wanted"))
    cut = work.write(docs.join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted").mapInArrow(_cut_out(kind), _CUT), "cut")
    more = cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_variants(kind), _FOUND)
    if not cut.where("hot").isEmpty():
        each = cut.where("hot").mapInArrow(_window_digests(kind), f"{_MEMBER}, high long, covered boolean, first int, last int, hi long, lo long")
        twice = work.write(each.groupBy("hi", "lo").agg(F.count("*").alias("k"), F.min("doc").alias("low"), F.max("high").alias("top")).where("low < top" if kind.across else "k > 1").select("hi", "lo"), "twice")
        more = more.unionByName(each.where("not covered").join(twice, ["hi", "lo"]).select(*more.columns))
    if kind.across:  # a variant may stand several times in its one document
        more = work.write(more, "more")
        again = more.where("c > 1").drop("doc", "th", "at").join(found.select(*_KEY, "doc", "th", "at"), _KEY)
        more = more.where("c = 1").unionByName(again)
    more = more.select("doc", "th", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + kind.length).alias("end"))
    out = work.write(ranges.unionByName(more).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    for name in ("repeated", "variants", "mixed", "cut", "more"):
        work.drop(name)
    return out


def remove_repeated(docs: DataFrame, work: Workspace | None = None, kind: Kind = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): byte spans removed and the remaining bytes."""
    rows = _keyed(docs).join(repeated_ranges(docs, work, kind), ["doc", "th"], "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(_keep(kind), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def without_repeats(docs: DataFrame, work: Workspace | None = None, kind: Kind = BYTES) -> DataFrame:
    """``docs`` with all their columns, the text less its repeated passages, and n_chars (if there) counted anew.

    A cut inside a character drops the character's other bytes. Rows whose whole text goes stay, empty; null texts stay null.
    """
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    d, h, r = (T.unused(names, n) for n in ("own_doc", "own_text", "own_ranges"))
    ranges = repeated_ranges(docs, work, kind).toDF(d, h, r)
    rows = docs.join(ranges, (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left").drop(d, h)

    def run(batches):
        for batch in batches:
            new, cols = [], batch.columns[:-1]
            for text, gone in zip(cols[at], batch.columns[-1], strict=True):
                text, gone = text.as_py(), gone.as_py()
                if gone and text:
                    raw = text.encode()
                    text = "".join(p.decode("utf-8", "ignore") for p in _without(raw, _spans(raw, gone, kind)))
                new.append(text)
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                cols[size] = pa.array([len(t or "") for t in new]).cast(cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.toDF(*T.numbered(rows.columns)).mapInArrow(T.released(run), docs.schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns on 400-byte passages; n_passages counts passages of over 50 words that another document has too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _keyed(docs).join(repeated_ranges(docs), ["doc", "th"], "left").join(repeated_ranges(docs, kind=WORDS).withColumnRenamed("ranges", "passages"), ["doc", "th"], "left")
    return rows.select("doc_id", "text", "ranges", "passages").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
