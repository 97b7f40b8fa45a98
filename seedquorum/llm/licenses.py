"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A header is a line that names a licence, compared with header wording; the document frequencies of its words come from every header of
the table. A licence file is a text whose whole bag of words is close to a licence's text (``licence_texts``: sparse vectors over the
templates' words, with the document frequencies of all texts), or one most of which is a header. Texts that cannot reach the
threshold, as their other words alone make them too long, are told apart by that bound; the rest are scored exactly.
Either way the best licence needs a margin before the second, and a line or title that states another version than the best has none; a line with
an SPDX identifier is taken by the whole identifier (of a compound the first), not by likeness.
A file without a licence of its own takes that of the licence file in the nearest directory above it: distinct directories list
their ancestors, which meet the licence files by an equi-join on the path, so a directory's files are never multiplied by its depth.

Defined cases: null and empty texts have no licence of their own; a text's likeness to a licence's text goes before its headers; of equal
scores of two licences neither wins, of several headers the best, then the first; a null path has no directory and inherits nothing;
rows that share id and path are told apart by their texts, repeated rows get a row each; an empty table gives an empty result;
texts of any length are scored whole; further columns aren't read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.llm.licence_texts import TEXTS
from seedquorum.plans.workspace import Workspace

#: Header wording by SPDX id.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "GFDL-1.3": ("Licensed under the GNU Free Documentation License, version 1.3", "SPDX-License-Identifier: GFDL-1.3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("Released under the ISC License", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "LGPL-2.0": ("Licensed under the GNU Library General Public License, version 2", "SPDX-License-Identifier: LGPL-2.0"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
}
NAMED = re.compile(r"licen[cs]e|released under|public domain|mozilla public", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
HEADER_SCORE, TEXT_SCORE = 0.6, 0.6
#: The best licence has to be so much nearer than the second: lines, texts.
HEADER_MARGIN, TEXT_MARGIN = 0.05, 0.01
SPDX = re.compile(r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+\-]+)(?:\s+(?:OR|AND|WITH)\s)?", re.IGNORECASE)
#: Where a version is stated: after the word, or after the short name of a Creative Commons licence.
STATED = re.compile(r"(?:\bversion|\bv\.?|\bcc[ -]by(?:-nc)?|\bcc0|attribution(?:-noncommercial)?)[ \t,]*(\d+(?:\.\d+)*)", re.IGNORECASE)
#: Characters of a text in which its title states the version.
TITLE = 300


def _number(version: str) -> str:
    return version.removesuffix(".0")


def other_version(name: str, text: str) -> bool:
    """Whether a text states a version first that isn't the licence's."""
    own, stated = re.search(r"-(\d+\.\d+)$", name), STATED.search(text)
    return bool(own and stated and _number(own[1]) != _number(stated[1]))


def identified(line: str) -> tuple[str, bool]:
    """The line with its SPDX identifier as the templates write it, and whether it has one; of a compound the first. Suffixes that allow later versions go."""
    m = SPDX.search(line)
    if not m:
        return line, False
    name = re.sub(r"(-only|-or-later|\+)$", "", m[1], flags=re.IGNORECASE).lower()
    known = {n.lower(): n for n in TEMPLATES}
    return f"SPDX-License-Identifier: {known.get(name, '')}", True


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = sorted({w for lines in TEMPLATES.values() for line in lines for w in words(line)})


def headers(text: str) -> list[tuple[int, str]]:
    """(start, line) of the lines that name a licence; each line once, in time proportional to the text."""
    out, end = [], -1
    for m in NAMED.finditer(text):
        if m.start() > end:
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            out.append((start, text[start:end]))
    return out


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ASCII letters and digits in lower case, and per row the range of its tokens."""
    start, end = T.runs(_ALNUM[data], bounds)
    return T.mix(T.range_hash(T.prefix_sums(T.LOWER[data]), start, end) + (end - start).astype(np.uint64)), np.searchsorted(start, bounds)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _tokens(data, np.array([0, len(data)]))[0]


#: The licence texts and their openings, which some files hold alone: names, words as sorted hashes, counts of them.
OPENING = 1500
_TEXTS = [(n, t) for n in sorted(TEXTS) for t in dict.fromkeys((TEXTS[n], TEXTS[n][:OPENING]))]
NAMES = [n for n, _ in _TEXTS]
TERMS = np.unique(np.concatenate([_hashes(t) for _, t in _TEXTS]))
COUNTS = np.array([np.bincount(np.searchsorted(TERMS, _hashes(t)), minlength=len(TERMS)) for _, t in _TEXTS], float)


def _known(h: np.ndarray) -> np.ndarray:
    """The tokens' numbers among the templates' words; -1 for others."""
    at = np.minimum(np.searchsorted(TERMS, h), len(TERMS) - 1)
    return np.where(TERMS[at] == h, at, -1)


_FOUND = "doc_id long, path string, th long, start long, line string, mostly boolean, term int, n long"


@T.released
def _headers(batches):
    """Header lines of each text; ``mostly``: they make up most of it. Last, the number of texts that hold each template word (-1: all)."""
    names, kinds = ["doc_id", "path", "th", "start", "line", "mostly", "term", "n"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] if rows else [()] * 8, kinds, strict=True)], names)
    total, n = np.zeros(len(TERMS), np.int64), 0
    for batch in batches:
        rows = []
        for doc, path, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "th")), batch.column("text"), strict=True):
            text = text.as_py() or ""
            found = [(doc, path, th, *h) for h in headers(text)]
            share = sum(len(f[4].strip()) for f in found)
            rows += [(*f, 2 * share > len(text.strip()), None, None) for f in found]
        data, offs = T.flat(batch.column("text"))
        for i, j in T.blocks(offs):
            h, at = _tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            k = _known(h)
            hit = np.flatnonzero(k >= 0)
            own = np.unique((np.searchsorted(at, hit, "right") - 1) * len(TERMS) + k[hit])
            total += np.bincount(own % len(TERMS), minlength=len(TERMS))
        n += batch.num_rows
        yield made(rows)
    yield made([(None, None, None, None, None, None, k, int(c)) for k, c in enumerate(total.tolist()) if c] + [(None, None, None, None, None, None, -1, n)])


def clearly_best(scores, text: str, margin: float) -> tuple[str, float] | None:
    """The nearest licence and its score, by the best of its templates, if it is ``margin`` nearer than any other.

    Licences of another version than ``text`` states can't be meant: they don't rival, but what is ``margin`` less near than one of them isn't meant either.
    """
    by: dict[str, float] = {}
    for name, score in scores:
        by[name] = max(score, by.get(name, 0.0))
    nearest = max(by.values())
    order = sorted((-score, name) for name, score in by.items() if not other_version(name, text))
    if not order:
        return None
    (score, name), second = order[0], order[1][0] if len(order) > 1 else 0.0
    return (name, -score) if second - score >= margin and -score > nearest - margin else None


class FileMatcher:
    """Cosines of whole texts to the licence texts."""

    def __init__(self, frequency: dict[int, int], n: int):
        self.idf = np.array([math.log((1 + n) / (1 + frequency.get(k, 0))) + 1 for k in range(len(TERMS))])
        self.other = math.log(1 + n) + 1
        weights = COUNTS * self.idf
        self.unit = weights / np.sqrt((weights**2).sum(1))[:, None]

    def __call__(self, column: pa.Array, least: float):
        """(row, name, score) of texts that reach ``least``."""
        data, offs = T.flat(column)
        for i, j in T.blocks(offs):
            h, at = _tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            k = _known(h)
            row = np.repeat(np.arange(j - i), np.diff(at))
            known = k >= 0
            cell, count = np.unique(row[known] * len(TERMS) + k[known], return_counts=True)
            weight = count * self.idf[cell % len(TERMS)]
            cell_row = cell // len(TERMS)
            square = np.bincount(cell_row, weight**2, j - i)
            others = np.bincount(row[~known], minlength=j - i)
            # the other words' squares are at least their number, and the cosine at most the known words' share
            for r in np.flatnonzero((square > 0) & (square >= least**2 * (square + others * self.other**2))):
                mine = slice(*np.searchsorted(cell_row, (r, r + 1)))
                vector = np.zeros(len(TERMS))
                vector[cell[mine] % len(TERMS)] = weight[mine]
                rest = h[at[r] : at[r + 1]][~known[at[r] : at[r + 1]]]
                norm = math.sqrt(square[r] + (np.unique(rest, return_counts=True)[1].astype(float) ** 2).sum() * self.other**2)
                scores = np.round(self.unit @ vector / norm, 9)
                text = data[offs[i + r] : min(offs[i + r] + TITLE, offs[i + r + 1])].tobytes().decode("utf-8", "replace")
                if found := clearly_best(zip(NAMES, scores.tolist(), strict=True), text, TEXT_MARGIN):
                    if found[1] >= least:
                        yield i + int(r), *found


_OWN = "doc_id long, path string, th long, license string, score double, start long, line string, file boolean, whole boolean"


def _files(frequency: dict[int, int], n: int):
    def run(batches):
        m = FileMatcher(frequency, n)
        for batch in batches:
            got = list(m(batch.column("text"), TEXT_SCORE))
            rows = pa.array([g[0] for g in got], pa.int64())
            cols = [batch.column(c).take(rows) for c in ("doc_id", "path", "th")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64()), pa.array([0] * len(got), pa.int64()), pa.nulls(len(got), pa.string()), *[pa.array([True] * len(got), pa.bool_())] * 2], ["doc_id", "path", "th", "license", "score", "start", "line", "file", "whole"])

    return T.released(run)


@T.released
def _frequencies(batches):
    place = {w: i for i, w in enumerate(VOCABULARY)}
    total, n = np.zeros(len(VOCABULARY), np.int64), 0
    for batch in batches:
        for line in batch.column("line").to_pylist():
            total[[place[w] for w in set(words(line)) if w in place]] += 1
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([*VOCABULARY, ""]), pa.array([*total.tolist(), n])], ["word", "n"])


class Matcher:
    """Cosines of a line to all templates."""

    def __init__(self, frequency: dict[str, int], n: int):
        self.idf = {w: math.log((1 + n) / (1 + frequency.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = math.log(1 + n) + 1
        self.templates = [(name, self._unit(line)) for name in sorted(TEMPLATES) for line in TEMPLATES[name]]

    def _unit(self, line: str) -> dict[str, float]:
        tf: dict[str, int] = {}
        for w in words(line):
            tf[w] = tf.get(w, 0) + 1
        weights = {w: c * self.idf.get(w, self.other) for w, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in weights.values())) or 1.0
        return {w: v / norm for w, v in weights.items()}

    def best(self, line: str) -> tuple[str | None, float]:
        """A line with an SPDX identifier has that licence or, if it is none of the templates', none."""
        line, spdx = identified(line)
        own = self._unit(line)
        scores = [(name, round(sum(v * own.get(w, 0.0) for w, v in t.items()), 9)) for name, t in self.templates]
        found = clearly_best(scores, "" if spdx else line, HEADER_MARGIN)
        return found if found and found[1] > 0 and not (spdx and line.endswith(" ")) else (None, 0.0)


def _match(frequency: dict[str, int], n: int):
    def run(batches):
        m = Matcher(frequency, n)
        for batch in batches:
            got = [m.best(line) for line in batch.column("line").to_pylist()]
            score = np.array([g[1] for g in got], float)
            file = batch.column("mostly").to_numpy(zero_copy_only=False).astype(bool)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "path", "th")), pa.array([g[0] for g in got], pa.string()), pa.array(score), batch.column("start"), batch.column("line"), pa.array(file, pa.bool_()), pa.array([False] * len(got), pa.bool_())], ["doc_id", "path", "th", "license", "score", "start", "line", "file", "whole"])
            yield out.filter(pa.array(score >= HEADER_SCORE))

    return T.released(run)


def directory(path):
    """A path's directory: all before the last slash; the root is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``files`` (doc_id, path, text) with license, score, start and line of the best header (a whole text's: 0 and null), is_license_file, inherited_from."""
    work = work or Workspace(files.sparkSession, "licenses")
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.xxhash64("text").alias("th"), "text")
    found = work.write(files.mapInArrow(_headers, _FOUND), "headers")
    terms = {r["term"]: r["n"] for r in found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per template word
    lines = found.where("term is null").drop("term", "n")
    df = {r["word"]: r["n"] for r in lines.select("line").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word of header wording
    n = df.pop("", 0)
    scored = lines.mapInArrow(_match(df, n), _OWN).unionByName(files.mapInArrow(_files(terms, terms.pop(-1, 0)), _OWN))
    key = ["doc_id", "path", "th"]
    own = scored.groupBy(*key).agg(F.max_by(F.struct("license", "score", "start", "line", "file"), F.struct("whole", "score", -F.col("start"))).alias("own"))
    own = work.write(own, "own")
    givers = own.where("own.file and path is not null").select(directory(F.col("path")).alias("up"), F.struct(-F.col("own.score"), "path", "own.license").alias("g"))
    givers = givers.groupBy("up").agg(F.min("g").alias("g"))
    hit = own.select(*(F.col(c).alias(f"own_{c}") for c in key), "own")
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key]
    rows = files.select(*key).join(hit, same[0] & same[1] & same[2], "left").select("doc_id", "path", "own", directory(F.col("path")).alias("dir"))
    dirs = rows.where("own is null and dir is not null").select("dir").distinct()
    steps = dirs.select("dir", F.split("dir", "/").alias("s"))
    above = steps.select("dir", F.explode(F.expr("transform(sequence(0, size(s)), k -> struct(k as depth, array_join(slice(s, 1, k), '/') as up))")).alias("a")).select("dir", "a.*")
    heir = work.write(above.join(givers, "up").groupBy("dir").agg(F.max_by(F.struct("g.license", "g.path"), "depth").alias("from")), "heirs")
    out = rows.join(heir, "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own.license", F.when(F.col("own").isNull(), F.col("from.license"))).alias("license"),
        F.col("own.score").alias("score"),
        F.col("own.start").alias("start"),
        F.col("own.line").alias("line"),
        F.coalesce("own.file", F.lit(False)).alias("is_license_file"),
        F.when(F.col("own").isNull(), F.col("from.path")).alias("inherited_from"),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string")).alias("path"), "text"))
