"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's logit is a bias plus the non-negative weights of its word features
(the word and its first four, five and six bytes, so that endings don't matter); the document's score is the noisy-or of
its sentences, and only document labels are needed to fit. The same sentence scores then locate the offending sentences.

The fit uses at most about ``max_rows`` labelled rows (hash order of doc_id, so the choice doesn't depend on layout);
labels, language, source and ids are never features. Defined cases: null, empty and blank texts score 0 and have no sentences; a
document listed twice with differing labels counts as toxic; without both labels present every score is the base rate of a sentence;
texts of any length are scored whole; features that stand out equally are taken by number;
further columns are not read; every input row gets one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.plans.shipping import ship
from seedquorum.plans.workspace import Workspace

MAX_ROWS = 20_000
BITS = 20
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (tokens x 4, -1 where a prefix would be the whole word), each token's sentence, sentence starts and ends."""
    keep = ~_STOP[data]
    s_start, s_end = T.runs(keep, bounds)
    start, end = T.runs(_TOKEN[data], bounds)
    sums = T.prefix_sums(T.LOWER[data])
    out = np.full((len(start), 1 + len(PREFIXES)), -1, np.int64)
    shift = np.uint64(64 - BITS)
    out[:, 0] = (T.mix(T.range_hash(sums, start, end)) >> shift).astype(np.int64)
    for k, n in enumerate(PREFIXES, 1):
        long = end - start > n
        out[long, k] = (T.mix(T.range_hash(sums, start[long], start[long] + n) + np.uint64(n)) >> shift).astype(np.int64)
    return out, np.searchsorted(s_start, start, "right") - 1, s_start, s_end


@T.released
def _count_features(batches):
    """Documents of either label that hold a feature, per task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        data, offs = T.flat(batch.column("text"))
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), np.int64)
        for i, j in T.blocks(offs):
            part, b = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            f, _, s_start, _ = features(part, b)
            token_start, _ = T.runs(_TOKEN[part], b)
            at = np.searchsorted(token_start, b)
            for r in range(j - i):
                u = np.unique(f[at[r] : at[r + 1]])
                counts[toxic[i + r], u[u >= 0]] += 1
    hit = np.flatnonzero(counts.any(0))
    for k in range(0, len(hit), 100_000):
        h = hit[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(counts[0, h], pa.int64()), pa.array(counts[1, h], pa.int64())], ["f", "clean", "toxic"])


def _bags(chosen: np.ndarray):
    """The rows' sentences as lists of chosen feature numbers."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batches):
        for batch in batches:
            data, offs = T.flat(batch.column("text"))
            n_sent, lists = [], []
            for i, j in T.blocks(offs):
                part, b = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                f, sent, s_start, _ = features(part, b)
                at = np.searchsorted(s_start, b)
                g = np.where(f >= 0, place[f], -1)
                rows, cols = np.nonzero(g >= 0)
                pairs = np.unique(sent[rows].astype(np.int64) << 32 | g[rows, cols])
                cut = np.searchsorted(pairs, at.astype(np.int64) << 32)
                n_sent += [*np.diff(at)]
                lists += [pairs[cut[r] : cut[r + 1]] - (int(at[r]) << 32) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(n_sent, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["toxic", "n", "pairs"])

    return T.released(run)


def _fit(toxic: np.ndarray, n: np.ndarray, pairs: list[np.ndarray], width: int, rounds: int = 400, l2: float = 2e-5) -> tuple[float, np.ndarray]:
    """Bias and non-negative weights that maximise the noisy-or likelihood; Adam on the whole sample."""
    doc = np.repeat(np.arange(len(n)), [len(p) for p in pairs])
    flat = np.concatenate(pairs) if len(doc) else np.zeros(0, np.int64)
    sent, inverse = np.unique(doc.astype(np.int64) << 32 | flat >> 32, return_inverse=True)
    f, of, plain = (flat & 0xFFFFFFFF).astype(np.int64), (sent >> 32).astype(np.int64), n - np.bincount((sent >> 32).astype(np.int64), minlength=len(n))
    w, b = np.full(width, 0.5), -8.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    y = toxic.astype(float)
    for t in range(1, rounds + 1):
        z = b + np.bincount(inverse, w[f], len(sent))
        soft = lambda x: np.logaddexp(0, x)
        free = plain * soft(b) + np.bincount(of, soft(z), len(n))  # -log of no sentence being toxic
        p = -np.expm1(-free)
        g = (1 - y) - y * (1 - p) / np.maximum(p, 1e-9)  # of the loss by free
        sig = lambda x: 1 / (1 + np.exp(-x))
        gz = g[of] * sig(z)
        grad = np.append(np.bincount(f, gz[inverse], width), gz.sum() + (g * plain).sum() * sig(b)) / len(n)
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(0, w - step[:-1]), min(-3.0, b - step[-1])
    return float(b), w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = 4096) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; null: unlabelled)."""
    work = Workspace(docs.sparkSession, "toxicity")
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    picked = lambda d: d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, max_rows / max(n, 1))) + 1))
    sample = work.write(picked(docs.select("doc_id", "text")).join(picked(labels), "doc_id").select("text", "toxic"), "sample")
    found = sample.mapInArrow(_count_features, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 4")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return -20.0, np.zeros(0, np.int64), np.zeros(0)
    # the features whose toxic share is most above the others', by a binomial deviation; ties by number
    found = found.withColumn("z", F.expr(f"(toxic / {pos}D - clean / {neg}D) / sqrt((toxic + clean + 1D) / {pos + neg}D / {pos}D)"))
    chosen = np.array([r["f"] for r in found.where("z > 3").orderBy(F.desc("z"), "f").limit(max_features).collect()], np.int64)
    bags = sample.mapInArrow(_bags(chosen), "toxic int, n long, pairs array<long>").toArrow()
    pairs = bags.column("pairs").combine_chunks()
    flat, offs = pairs.flatten().to_numpy(), pairs.offsets.to_numpy()
    b, w = _fit(bags.column("toxic").to_numpy(), bags.column("n").to_numpy(), [flat[offs[i] - offs[0] : offs[i + 1] - offs[0]] for i in range(len(pairs))], len(chosen))
    work.close()
    return b, chosen, w


class Scorer:
    """Scores the texts of a batch with one model."""

    def __init__(self, model: tuple[float, np.ndarray, np.ndarray], threshold: float):
        self.bias, chosen, w = model
        self.threshold = threshold
        self.weight = np.zeros((1 << BITS) + 1)
        self.weight[chosen] = np.where(w > 1e-3, w, 0)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and the sentences at or above the threshold."""
        data, offs = T.flat(column)
        scores, found = [np.zeros(0)], []
        for i, j in T.blocks(offs):
            part, b = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            f, sent, s_start, s_end = features(part, b)
            z = np.full(len(s_start), self.bias)
            z += np.bincount(sent, self.weight[f].sum(1), len(s_start)) if len(f) else 0
            free = np.append(0.0, np.cumsum(np.logaddexp(0, z)))
            at = np.searchsorted(s_start, b)
            scores.append(np.clip(-np.expm1(-(free[at[1:]] - free[at[:-1]])), 0, 1))
            p = 1 / (1 + np.exp(-z))
            hot = np.flatnonzero(p >= self.threshold)
            cut = np.searchsorted(hot, at)
            for r in range(j - i):
                own = hot[cut[r] : cut[r + 1]]
                if len(own):
                    chars = np.append(0, np.cumsum(part[b[r] : b[r + 1]] & 0xC0 != 0x80))
                    found.append([{"start": int(chars[s_start[k] - b[r]]), "end": int(chars[s_end[k] - b[r]]), "score": float(p[k])} for k in own])
                else:
                    found.append([])
        return np.concatenate(scores), found


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, sentences): the sentences at or above the threshold, as code point ranges with their probability."""
    ship(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model, threshold)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = scorer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.released(run), "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def passing(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns, of any names."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model, threshold)
        for batch in batches:
            kept = batch.filter(pa.array(scorer(batch.column(at))[0] < threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    return docs.toDF(*T.numbered(names)).mapInArrow(T.released(run), docs.schema)


def fold():
    """The contract's remainder of a document."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """A model from the labels that aren't held out."""
    return fit(docs, labels.select("doc_id", "toxic").where(fold() != 2))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit_on_folds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "sentences")
