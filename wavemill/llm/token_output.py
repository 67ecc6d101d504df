"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus' id frequencies (most frequent first, ties by id), so frequent ids take one
byte. A block stores four ids per control byte (two bits each: its bytes less one) apart from the data bytes; decoding
looks each control byte up in a 256-row table of lengths, all in numpy.

Files. `ids/` has a row per block: part (the file's place in doc_id order), first (ids of the part before the block),
doc_ids and counts (int64 and uint32 arrays), control, data. `ranks/` has the id of each rank. Both are Parquet tables,
so any store that Spark writes to will do. Blocks hold whole documents of together about BLOCK_IDS ids.

Defined results: a null text counts as empty and has the end id only; a very long text is encoded whole and makes a
block of its own; rows that share a doc_id are written one after
the other, ordered by their ids; a null doc_id sorts first; extra columns are ignored, whatever their names; an empty
table gives empty files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, pieces_for, raw_text, read_table, scratch_folder, small_batches
from .tokens import ENCODE_BYTES, default_path, encoder, text_list

BLOCK_IDS, PART_IDS = 1 << 19, 1 << 22
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF) + np.uint8(1)
    width = 2 if size.max(initial=1) <= 2 else 4
    kept = np.arange(width, dtype=np.uint8) < size[:, None]
    data = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[kept]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = d[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= d[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and the whole text's ids (little-endian, of the encoder's width), end id included."""

    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in small_batches(batches, limit=ENCODE_BYTES):
            ids = [x.tobytes() + end for x in enc.encode(text_list(*raw_text(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _frequencies(size: int, kind):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw, _ = raw_text(batch.column(0))
            total += np.bincount(np.ascontiguousarray(raw).view(kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return run


def _encode_blocks(rank_of: np.ndarray, kind):
    width = np.dtype(kind).itemsize

    def run(batches):
        first, docs, ids, held = 0, [], [], 0

        def block():
            values = rank_of[np.frombuffer(b"".join(ids), kind)]
            control, data = pack(values)
            row = [part, first, len(values), np.array([-1 if d is None else d for d in docs], np.int64).tobytes(), bytes(d is None for d in docs), np.array([len(x) // width for x in ids], np.uint32).tobytes(), control, data]
            return pa.RecordBatch.from_pylist([dict(zip(_FORMAT.names, row, strict=True))], schema=_FORMAT)

        for batch in batches:
            for p, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                docs.append(d)
                ids.append(x)
                held += len(x) // width
                if held >= BLOCK_IDS:
                    yield block()
                    first, docs, ids, held = first + held, [], [], 0
        if docs:
            yield block()

    return run


_FORMAT = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("counts", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
_BLOCK_ROW = "part int, first long, n_ids long, doc_ids binary, no_id binary, counts binary, control binary, data binary"


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1) -> None:
    """Tokenise docs and write their ids to `folder` in ascending doc_id order."""
    spark = docs.sparkSession
    path = path or default_path()
    enc = encoder(path)
    size = max(enc.size, end_id + 1)
    ids = materialise(tokenised(docs, path, end_id), "ids")
    counts = ids.select("ids").mapInArrow(_frequencies(size, enc.kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # at most a row per id of the vocabulary
    order = counts["id"].to_numpy(np.int32)
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(order)), pa.int32()), "id": pa.array(order)})).coalesce(1).write.parquet(f"{folder}/ranks")
    parts = pieces_for(spark, int(counts["n"].sum()), PART_IDS)
    dealt = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    dealt.mapInArrow(_encode_blocks(rank_of, enc.kind), _BLOCK_ROW).write.option("compression", "zstd").parquet(f"{folder}/ids")
    discard(ids)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit) of every document, decoded from the files."""
    ranks = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    id_of = ranks["id"].to_numpy(np.uint32)  # at most a row per id of the vocabulary

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                n = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
                raw, ends = ids.tobytes(), np.cumsum(n)
                own = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["no_id"], bool))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(n), pa.int32()), doc, pa.array(row["first"] + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.schema(_BLOCK_ROW).parquet(f"{folder}/ids")
    # one row a part: as few as the files
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    rows = blocks.mapInArrow(decode, "part int, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(begin, "part").select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/token-output-{uuid.uuid4().hex}"
    write_ids(read_table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder).drop("ids")
