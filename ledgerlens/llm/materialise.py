"""Training-order materialisation: sequences in a keyed random order, as fixed-stride binary shards.

1. Documents are tokenised and run together, each with the end id, within the
   tasks that read them, and cut into sequences of ``length`` ids; a task's
   last one is filled up with end ids. Tasks' counts of sequences give each
   its number in the whole.
2. A Feistel network keyed by ``key`` permutes the numbers 0 .. n - 1 (over
   the next even power of two, cycle-walking back into the range): the slot of
   each sequence, without a shuffle table or a sort of random keys.
3. Shard s has the slots from s * per_shard on. Each shard is one task's
   partition, sorted by slot, and one file.

A record is the ids as unsigned little-endian 16-bit numbers and then the
number 10, two bytes that Spark's text sink writes as its line separator. So
every file is an array of 16-bit numbers of the shape (records, length + 1),
slot k is record k % per_shard of shard k // per_shard, and a reader resumes
at any slot by a seek. Spark's own committer writes the files, so lost tasks
leave nothing behind and any file system that Spark knows will do. On their
way there sequences are compressed one by one.

Beside the shards lie ``index`` (slot and its documents' pieces) and, written
last, ``shape`` (one row: sequences, length, records a shard, key). So the path
alone is enough for any later session: ``open_shards`` reads the shape, and
``read_records`` goes on from any slot and leaves earlier shards unread.

A task holds one record batch at a time; no group is gathered.

Defined results: null text is a document of the end id alone. Texts of any
length run on over sequences. Every row is written, repeated rows and null ids
too. No rows: no sequence and no shard. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_shuffles, text_of, written
from .tokenizer import VOCABULARY, pieces

END = 1
_ROUNDS = 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _round(x: np.ndarray, key: int, i: int) -> np.ndarray:
    x = (x + np.uint64((key + 0x9E3779B97F4A7C15 * (i + 1)) % 2**64)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1 at ``x``. Another pass for values beyond n, at most four on average."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(x, np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        v = out[walk]
        left, right = v >> bits, v & mask
        for i in range(_ROUNDS):
            left, right = right, left ^ (_round(right, key, i) & mask)
        v = left << bits | right
        out[walk] = v
        walk = walk[v >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """What was written: the folder, the shards' shape, and the index (slot, docs: doc_id, start, length, offset)."""

    path: str
    sequences: int
    length: int
    per_shard: int
    key: int
    index: DataFrame

    @property
    def stride(self) -> int:
        return 2 * (self.length + 1)

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


_SPANS = "array<struct<doc_id:long,start:long,length:long,offset:long>>"
_SHAPE = "sequences long, length long, per_shard long, key long"


def open_shards(spark: SparkSession, path: str) -> Shards:
    """The shards that some session wrote to the end under ``path``."""
    n, length, per_shard, key = spark.read.schema(_SHAPE).parquet(f"{path}/shape").first()
    return Shards(path, n, length, per_shard, key, spark.read.schema(f"slot long, docs {_SPANS}").parquet(f"{path}/index"))


def cut_sequences(docs: DataFrame, length: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """task, i, ids (16 bits each, compressed), n_ids (without filling), docs: one written row a sequence."""
    span = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]))
    schema = pa.schema([("task", pa.int32()), ("i", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("docs", span)])
    end = END.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task, i = pieces(vocabulary), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        held, room, spans = [], length, []
        rows: list[list] = [[] for _ in schema]

        def close(n: int) -> None:
            nonlocal i, held, room, spans
            for c, v in zip(rows, (task, i, pack(b"".join(held) + end * (length - n)), n, spans), strict=True):
                c.append(v)
            i, held, room, spans = i + 1, [], length, []

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            for c in rows:
                c.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, at = cache.ids(text) + end, 0
                while at < len(ids) // 2:
                    take = min(room, len(ids) // 2 - at)
                    held.append(ids[2 * at:2 * (at + take)])
                    spans.append({"doc_id": doc, "start": at, "length": take, "offset": length - room})
                    at, room = at + take, room - take
                    if not room:
                        close(length)
                        if len(rows[0]) >= 1000:
                            yield out()
        if held:
            close(length - room)
        yield out()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, f"task int, i long, ids binary, n_ids long, docs {_SPANS}"), "sequences")


def materialise(docs: DataFrame, path: str, length: int = 2048, per_shard: int = 2048, key: int = 20240229,
                vocabulary: str = VOCABULARY) -> Shards:
    """Write all rows of ``docs`` (doc_id, text) as shards under ``path`` (shard=0, shard=1, ...)."""
    spark = docs.sparkSession
    sequences = cut_sequences(docs, length, vocabulary)
    first, n = {}, 0
    for r in sequences.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():  # a row a task
        first[r["task"]], n = n, n + r["n"]
    begin = spark.sparkContext.broadcast(first)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = np.array([begin.value[t] for t in b.column("task").to_pylist()], np.int64) + b.column("i").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(feistel(numbers, n, key), pa.int64()), b.column(2)], names=["slot", b.schema.names[2]])

    def with_slots(col: str, kind: str) -> DataFrame:
        return sequences.select("task", "i", col).mapInArrow(slots, f"slot long, {col} {kind}")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                ids = [ids_of(x.as_buffer()) for x in s.column("ids")]
                yield pa.RecordBatch.from_arrays([s.column("shard"), s.column("slot"), pa.array(ids, pa.binary())], names=["shard", "slot", "ids"])

    shards = -(-n // per_shard)
    if n:
        placed = with_slots("ids", "binary").withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
        (placed.repartitionById(shards, F.col("shard")).mapInArrow(unpack, "shard int, slot long, ids binary")
         .sortWithinPartitions("shard", "slot")
         .select("shard", F.col("ids").cast("string").alias("value"))
         .write.partitionBy("shard").option("lineSep", "\n\0").option("compression", "none").text(path))
        release_shuffles(spark)
    with_slots("docs", _SPANS).write.parquet(f"{path}/index")
    spark.createDataFrame([(n, length, per_shard, key)], _SHAPE).coalesce(1).write.parquet(f"{path}/shape")
    return open_shards(spark, path)


def read_records(spark: SparkSession, shards: Shards, first_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, ids_crc32 from ``first_slot`` on: the CRC-32 of each record's ids as 32-bit numbers, read back from the files."""
    stride, per_shard = shards.stride, shards.per_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = int(re.search(r"shard=(\d+)", name)[1])
                records = np.frombuffer(content.as_buffer(), "<u2").reshape(-1, stride // 2)
                if not (records[:, -1] == 10).all():
                    raise ValueError(f"{name} is not of stride {stride}")
                k = np.arange(max(first_slot - shard * per_shard, 0), len(records))
                crcs = [zlib.crc32(r.astype("<u4").tobytes()) for r in records[k, :-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * per_shard + k), pa.array(np.full(len(k), shard)), pa.array(k * stride), pa.array(crcs, pa.int64())],
                    names=["slot", "shard", "byte_offset", "ids_crc32"])

    schema = "slot long, shard long, byte_offset long, ids_crc32 long"
    if first_slot >= shards.sequences:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("basePath", shards.path).load(f"{shards.path}/shard=*")
    files = files.where(F.col("shard") >= first_slot // per_shard)      # a partition column: earlier folders go unread
    return files.select("path", "content").mapInArrow(run, schema)
