"""Questions from chunks of texts to hash buckets, and the answers back, without moving a row per text position.

Deduplication at the level of bytes or words has far more positions than a shuffle should carry. Here the texts are
written once as chunks (many texts in one row, compressed). Every chunk sends each bucket one row with all its
distinct keys of that bucket, packed; a bucket sees the keys of all chunks and answers each chunk with a packed reply
in the order of the keys. A key that a third of all texts hold reaches its bucket once per chunk, not once per text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.arrays import buffers, pieces
from scorelake.plans.lineage import checkpoint_folder

#: Bytes of text in a chunk. A longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20


_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def scratch(spark: SparkSession, name: str, stays: bool = False) -> str:
    """A new folder in the session's shared checkpoint folder. ``stays``: also beyond ``passing``."""
    return f"{(not stays and _passing.get()) or checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written inside goes to one folder, which is deleted at the end, but for what is said to stay."""
    folder = scratch(spark, name)
    token = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that no later step runs it again."""
    folder = scratch(df.sparkSession, name, stays)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pack(values: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(values if isinstance(values, bytes) else np.ascontiguousarray(values).data)


def unpack(blob, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw if dtype is None else np.frombuffer(raw, dtype)


class Chunk:
    """Some whole texts: ``ids`` (Arrow), ``data`` and ``offsets``."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, body) -> None:
        self.ids = ids
        self.offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.data = np.frombuffer(unpack(body), np.uint8)


def write_chunks(texts: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Rows (chunk, n_bytes, ids, sizes, body), written to the shared folder. Null texts count as empty."""
    id_type = texts.schema[id_col].dataType
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("body", T.BinaryType()),
        ]
    )

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                data, offsets = buffers(piece.column("text"))
                ids = piece.column("id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([len(data)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([pack(np.diff(offsets))], pa.binary()),
                        pa.array([pack(data, 3)], pa.binary()),  # shuffled with every pass
                    ],
                    names=["chunk", "n_bytes", "ids", "sizes", "body"],
                )
                number += 1

    return written(rows.mapInArrow(chunked, schema), name)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, dict]]:
    """(chunk number, texts, row) for each row of a table of ``write_chunks``."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids").slice(i, 1).flatten()
            sizes = unpack(batch.column("sizes")[i].as_buffer(), np.int64)
            chunk = Chunk(ids, sizes, batch.column("body")[i].as_buffer())
            yield batch.column("chunk")[i].as_py(), chunk, {"batch": batch, "row": i}
            # what one chunk took goes back before the next begins, so that a worker's memory is that of its largest chunk
            del chunk, ids, sizes
            pa.default_memory_pool().release_unused()


def bucket_count(chunks: DataFrame, bytes_per_bucket: int, least: int = 96) -> int:
    """Buckets in proportion to the bytes of text, so that what meets in one of them stays bounded."""
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(least, -(-total // bytes_per_bucket))


#: A question: keys of one chunk for one bucket. An answer goes back to the chunk with the bucket's number.
QUESTION = "chunk bigint, bucket int, body binary"


def ask(chunks: DataFrame, questions: Callable[[int, Chunk, dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """One row (chunk, bucket, body) for each pair that ``questions`` yields for a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, row in chunks_of(batches):
            found = list(questions(number, chunk, row))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(found), pa.int64()),
                        pa.array([b for b, _ in found], pa.int32()),
                        pa.array([x for _, x in found], pa.binary()),
                    ],
                    names=["chunk", "bucket", "body"],
                )

    return chunks.mapInArrow(run, QUESTION)


def answer(questions: DataFrame, reply: Callable[[list], Iterator[bytes | None]]) -> DataFrame:
    """``reply`` gets all bodies of a bucket and yields an answer, or None, for each in the same order."""

    def run(table: pa.Table) -> pa.Table:
        bodies = [x.as_buffer() for x in table.column("body")]
        replies = pa.array(list(reply(bodies)), pa.binary())
        out = pa.table([table.column("chunk"), table.column("bucket"), replies], names=["chunk", "bucket", "body"])
        return out.filter(replies.is_valid())

    return questions.groupBy("bucket").applyInArrow(run, QUESTION)


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``chunks`` with the column ``name``: (bucket, body) of each bucket that answered, as an array."""
    got = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
    return chunks.join(got, "chunk", "left")


def answers_of(row: dict, name: str) -> dict[int, pa.Buffer]:
    got = row["batch"].column(name).slice(row["row"], 1).flatten()
    return {b.as_py(): x.as_buffer() for b, x in zip(got.field("bucket"), got.field("body"), strict=True)}


class Keys:
    """The distinct 64-bit keys of a chunk, by bucket: the top 32 bits choose it, the low 32 bits are sent, or with ``check``
    (64 further bits of each key) all 128."""

    def __init__(self, keys: np.ndarray, buckets: int, check: np.ndarray | None = None) -> None:
        self.check: np.ndarray | None = None
        if check is None:
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            sent = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
            self.sent, self.which, self.count = np.unique(sent, return_inverse=True, return_counts=True)
            bucket = (self.sent >> np.uint64(32)).astype(np.int64)
            self.sent = self.sent.astype(np.uint32)
        else:
            first, self.which, self.count = distinct_pairs(keys, check)
            bucket = ((keys[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            first, self.which, self.count, bucket = first[order], place[self.which], self.count[order], bucket[order]
            self.sent, self.check = keys[first], check[first]
        self.extra: np.ndarray | None = None  # one byte for each distinct key, sent behind the keys
        self.buckets, at = np.unique(bucket, return_index=True)
        self.at = np.append(at, len(bucket))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        columns = [x for x in (self.sent, self.check, self.extra) if x is not None]
        for i, b in enumerate(self.buckets):
            mine = slice(self.at[i], self.at[i + 1])
            yield int(b), b"".join(x[mine].tobytes() for x in columns)

    def marked(self, answers: dict[int, pa.Buffer], part: int = 0) -> np.ndarray:
        """For each key of the constructor, its bit in the given part of the answers (first: other chunks hold it too)."""
        flags = np.zeros(len(self.sent), bool)
        for i, b in enumerate(self.buckets):
            if int(b) in answers:
                n = self.at[i + 1] - self.at[i]
                bits = np.frombuffer(answers[int(b)], np.uint8, -(-n // 8), part * -(-n // 8))
                flags[self.at[i] : self.at[i + 1]] = np.unpackbits(bits, count=n)
        return flags[self.which]


def distinct_pairs(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first of each distinct pair (key, check), the number of each row's pair, and how often each occurs."""
    _, first, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if (check[first][which] != check).any():  # two pairs of one key
        pair = np.empty(len(keys), [("key", np.uint64), ("check", np.uint64)])
        pair["key"], pair["check"] = keys, check
        _, first, which, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    return first, which, count


def shared_keys(bodies: list) -> Iterator[bytes | None]:
    """A reply for ``answer``: a bit for each key of 32 bits, set where two chunks or more have sent it."""
    parts = [np.frombuffer(x, np.uint32) for x in bodies]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    for part in parts:
        hit = np.zeros(len(part), bool)
        if len(twice):
            at = np.searchsorted(twice, part)
            hit = twice[np.minimum(at, len(twice) - 1)] == part
        yield np.packbits(hit).tobytes() if hit.any() else None


def shared_pairs(bodies: list) -> Iterator[bytes | None]:
    """The same for keys with a check, which are compared by all 128 bits."""
    size = [len(x) // 16 for x in bodies]
    keys = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(bodies, size, strict=True)])
    check = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(bodies, size, strict=True)])
    _, which, count = distinct_pairs(keys, check)
    at = 0
    for n in size:
        hit = count[which[at : at + n]] > 1
        at += n
        yield np.packbits(hit).tobytes() if hit.any() else None
