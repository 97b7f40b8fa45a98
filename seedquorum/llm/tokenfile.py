"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus (frequent first), a rank takes one to four bytes, and two bits of a control byte say
how many. A block holds: magic, counts, document ids, document lengths, control bytes, data bytes. Decoding is a numpy
table look-up from control bytes to lengths. Shards are in ascending doc_id order; a block also knows its first id's place
within its shard.

Blocks are written as a binary column through Spark's own writer, so any store that Spark reaches will do and a lost
executor's shard is written again under Spark's commit protocol. The rank table lies beside the shards.

Defined cases: null and empty texts hold just the end id; repeated doc_ids keep a place each (ordered by text); a null doc_id stands
in the files as the smallest 64-bit number, comes first and is read back as null; texts of any length are encoded whole, ids of equal frequency are ranked by number; an empty table gives no shards; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.llm import tokens
from seedquorum.plans.workspace import Workspace

MAGIC = b"SQT1"
_HEAD = struct.Struct("<4sQQQQ")
#: Lengths of the four ids under each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
BLOCK_IDS = 1 << 20
NO_ID = -(1 << 63)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    square = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), square[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(docs: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join([_HEAD.pack(MAGIC, len(docs), len(ranks), len(data), start), docs.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), control, data])


def unpack_block(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, lengths, ranks, and the place of the first id within the shard."""
    magic, n_docs, n_ids, n_data, start = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    sizes = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    n_control = -(-n_ids // 4)
    ranks = decode_ranks(np.frombuffer(raw, np.uint8, n_control, at), np.frombuffer(raw, np.uint8, n_data, at + n_control), n_ids)
    return docs, sizes, ranks, start


def _tokenize(path: str, end_id: int):
    """Texts in ascending doc_id order to blocks of plain ids; the partition is the shard. Its last row, block -1, counts its ids."""

    def run(batches):
        enc, shard, block, start = tokens.encoder(path, end_id), TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, held, total = [], [], [], 0, np.zeros(1 << 16, np.int64)

        def row(block: int, start: int, n: int, width: int, *raw: np.ndarray) -> pa.RecordBatch:
            cols = [(shard, pa.int32()), (block, pa.int32()), (start, pa.int64()), (n, pa.int64()), (width, pa.int32()), *((x.tobytes(), pa.binary()) for x in raw)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in cols], ["shard", "block", "start", "n_ids", "width", "docs", "sizes", "ids"])

        def out():
            nonlocal block, start, docs, sizes, parts, held, total
            ids = np.concatenate(parts)
            c = np.bincount(ids, minlength=len(total))
            c[: len(total)] += total
            raw = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            made = row(block, start, held, raw.dtype.itemsize, np.concatenate(docs).astype("<i8"), np.concatenate(sizes).astype("<u4"), raw)
            block, start, docs, sizes, parts, held, total = block + 1, start + held, [], [], [], 0, c
            return made

        for batch in batches:
            own = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for i, j, ids, n in enc.slices(batch.column("text")):
                docs.append(own[i:j])
                sizes.append(n)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield out()
        if held:
            yield out()
        hit = np.flatnonzero(total)
        yield row(-1, 0, 0, 0, np.zeros(0), hit.astype("<i8"), total[hit].astype("<i8"))

    return T.released(run)


_PLAIN = "shard int, block int, start long, n_ids long, width int, docs binary, sizes binary, ids binary"


def _ids(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.int64)


@T.released
def _counts(batches):
    for batch in batches:
        for ids, n in zip(batch.column("sizes"), batch.column("ids"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<i8")) for x in (ids, n)], ["id", "n"])


def _write(ids_by_rank: np.ndarray):
    def run(batches):
        rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
        rank[ids_by_rank] = np.arange(len(ids_by_rank))
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                made.append(pack_block(np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["sizes"], "<u4"), rank[_ids(r["width"], r["ids"])], r["start"]))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), batch.column("n_ids"), pa.array(made, pa.binary())], ["shard", "block", "n_ids", "payload"])

    return T.released(run)


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int, shards: int | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) and writes ``target``/shards and ``target``/ranks.

    One shuffle, of the texts, puts documents in order; the ids are kept once as plain blocks, with their counts per shard, until
    their frequencies are known.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    made = work.write(in_order.mapInArrow(_tokenize(path, end_id), _PLAIN), "ids", compression="zstd")
    counts = made.where("block < 0").select("sizes", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.int64)  # at most the vocabulary
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id long").coalesce(1).write.parquet(f"{target}/ranks")
    made.where("block >= 0").mapInArrow(_write(by_rank), "shard int, block int, n_ids long, payload binary").write.option("compression", "none").parquet(f"{target}/shards")
    work.close()


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    ranks = spark.read.parquet(f"{target}/ranks").orderBy("rank").collect()
    by_rank = np.array([r["id"] for r in ranks], "<u4")

    def decode(batches):
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                docs, sizes, r, start = unpack_block(raw.as_buffer())
                ids = by_rank[r]
                cut = np.append(0, np.cumsum(sizes, dtype=np.int64))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), shard, np.int32)), pa.array(docs, mask=docs == NO_ID), pa.array(start + cut[:-1]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(f"{target}/shards")
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = totals.select("shard", before.alias("first"))  # a row per shard
    rows = shards.select("shard", "payload").mapInArrow(T.released(decode), "shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(places, "shard").select("doc_id", (F.col("first") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_output(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = Workspace(spark, "token-files").root
    write_token_files(docs, target, path or tokens.default_path(), end_id=2)
    return read_token_files(spark, target)
