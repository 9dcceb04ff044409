"""Token ids of page texts in Huffman-coded files.

The ids of all texts are counted first, and one canonical code of limited length is made from the counts. A file holds the
pages of one stretch of the page order: their numbers and token counts, the code as the length of each id's code word,
the ids as one run of bits, and the bit at which each block of ids begins. Blocks are independent: a reader decodes them side
by side, a table giving the id and the length for the next bits, or only those that it needs.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.arrays import pieces, ragged
from scorelake.llm.exchange import pack, unpack, written

#: First bytes of a file and, as the separator of Spark's text writer, its last ones.
MAGIC, END = b"TOKF1\r\n\0", "\x04TOKF\n"
HEAD = "<8sqqqqiiqqqq"
#: Longest code word in bits; a larger vocabulary takes as many as it needs.
CODE_BITS = 18
#: Ids of a block, and ids from which on a file ends after the page.
BLOCK_IDS, FILE_IDS = 256, 1 << 20
SLICE_BYTES = 1 << 20
#: Units of text whose ids a task remembers.
KNOWN_UNITS = 1 << 19


class TokenFileError(ValueError):
    """A file that isn't what its header says."""


def code_lengths(counts: np.ndarray, bits: int = CODE_BITS) -> np.ndarray:
    """Length of each id's code word, 0 for ids that don't occur: the best ones of at most ``bits`` bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    bits = max(bits, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    row, rows = weight, [np.ones(len(order), bool)]
    for _ in range(bits - 1):  # each row: the ids, merged with the pairs of the row before
        both = np.concatenate([weight, row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)])
        by = np.argsort(both, kind="stable")
        row = both[by]
        rows.append(by < len(weight))
    take, length = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for is_id in reversed(rows):
        ids = int(is_id[:take].sum())
        length[:ids] += 1
        take = 2 * (take - ids)
    out[order] = length
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code words: by length, then by id, each the next number of its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    if len(order):
        size = lengths[order].astype(np.uint64)
        step = np.uint64(1) << (size.max() - size)  # what a word takes of the longest words' numbers
        out[order] = (np.cumsum(step) - step) >> (size.max() - size)
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
    """The code words of ``ids`` as bits, first bit first, and the bit at which each block begins."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ids) else 0
    at = ends - size
    out = np.zeros(total // 64 + 2, np.uint64)
    # a word of up to 32 bits touches one or two of the 64-bit numbers
    place, offset = at >> 6, (at & 63).astype(np.uint64)
    code = words[ids] << (np.uint64(64) - size.astype(np.uint64)) if len(ids) else words[ids]
    spilled = np.where(offset > 0, code << ((np.uint64(64) - offset) & np.uint64(63)), np.uint64(0))
    for where, value in ((place, code >> offset), (place + 1, spilled)):
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else where
        if len(first):
            out[where[first]] |= np.bitwise_or.reduceat(value, first)
    return out.astype(">u8").tobytes()[: -(-total // 8)], at[::block]


class Decoder:
    """The ids of a code, looked up by the next bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.bits = int(lengths.max()) if len(used) else 0
        order = used[np.lexsort((used, lengths[used]))]
        step = 1 << (self.bits - lengths[order].astype(np.int64))
        self.ids = np.full(1 << self.bits, -1, np.int32)
        self.sizes = np.zeros(1 << self.bits, np.uint8)
        self.ids[: step.sum()], self.sizes[: step.sum()] = np.repeat(order, step), np.repeat(lengths[order], step)

    def blocks(self, data: bytes, begin: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
        """The ids of the blocks that begin at these bits and hold ``count`` ids each, one id of all blocks at a time."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        ahead = np.zeros(len(raw) - 7, np.uint64)  # the 64 bits from each byte on
        for k in range(8):
            ahead |= raw[k : k + len(ahead)].astype(np.uint64) << np.uint64(56 - 8 * k)
        out = np.empty(int(count.sum()), np.uint32)
        to, at, left = np.cumsum(count) - count, begin.astype(np.int64), count
        shift, step = np.uint64(64 - self.bits), 0
        while len(at):
            if (at >= end).any():
                raise TokenFileError("a block runs beyond the bits")
            look = ((ahead[at >> 3] << (at & 7).astype(np.uint64)) >> shift).astype(np.int64)
            found = self.ids[look]
            if (found < 0).any():
                raise TokenFileError("bits that are no code word")
            out[to + step] = found
            at = at + self.sizes[look]
            step += 1
            more = left > step
            if not more.all():
                at, to, left = at[more], to[more], left[more]
        return out


def write_file(part: int, before: int, pages: pa.Array, n_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A file without its end mark. ``part``: a stretch of the page order; ``before``: ids of the part before the file's; ``pages``: their
    numbers, of any Arrow type."""
    body, checkpoints = encode(ids, lengths, code_words(lengths), block)
    table = pa.RecordBatch.from_arrays([pages, pa.array(n_tokens, pa.int64())], names=["page", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    parts = [pack(sink.getvalue().to_pybytes()), pack(lengths), pack(np.diff(checkpoints, prepend=0))]
    head = struct.pack(HEAD, MAGIC, part, before, len(ids), int(lengths[ids].sum(dtype=np.int64)), block, len(pages), *map(len, parts), len(body))
    return b"".join([head, *parts, body])


class TokenFile:
    """A file that ``write_file`` made: ``part``, ``before``, ``pages``, ``n_tokens``, and its ids in whole or in part."""

    def __init__(self, data) -> None:
        data = memoryview(data)
        if len(data) < struct.calcsize(HEAD) or bytes(data[:8]) != MAGIC:
            raise TokenFileError("no token file")
        _, self.part, self.before, self.n_ids, self.n_bits, self.block, n_pages, *sizes = struct.unpack_from(HEAD, data)
        ends = np.cumsum([struct.calcsize(HEAD), *sizes])
        if ends[-1] + len(END) != len(data) or bytes(data[ends[-1] :]) != END.encode() or -(-self.n_bits // 8) != sizes[-1]:
            raise TokenFileError("a token file is cut off or has bytes left over")
        pages, lengths, checkpoints = (unpack(data[a:b]) for a, b in zip(ends[:3], ends[1:4], strict=True))
        table = pa.ipc.open_stream(pages).read_all()
        self.pages, self.n_tokens = table.column("page").combine_chunks(), table.column("n_tokens").to_numpy()
        if len(self.pages) != n_pages or self.n_tokens.sum() != self.n_ids:
            raise TokenFileError("a token file doesn't hold the ids of its pages")
        self.lengths = np.frombuffer(lengths, np.uint8)
        self.checkpoints = np.cumsum(np.frombuffer(checkpoints, np.int64))
        self.body = bytes(data[ends[3] : ends[4]])

    def ids(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from number ``first`` of the file on; only the blocks that hold them are decoded."""
        count = self.n_ids - first if count is None else count
        if not count:
            return np.zeros(0, np.uint32)
        if first < 0 or first + count > self.n_ids:
            raise IndexError("ids beyond the file")
        low, high = first // self.block, -(-(first + count) // self.block)
        sizes = np.minimum(self.n_ids - np.arange(low, high) * self.block, self.block)
        found = _decoder(self.lengths.tobytes()).blocks(self.body, self.checkpoints[low:high], sizes, self.n_bits)
        return found[first - low * self.block :][:count]


@functools.lru_cache(maxsize=1)
def _decoder(lengths: bytes) -> Decoder:
    return Decoder(np.frombuffer(lengths, np.uint8))


class _Numbers(dict):
    """Numbers for units in the order of their first look-up; ``new`` collects those that had none."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = number = len(self)
        return number


class Coder:
    """A tokenizer of the tokenizers library, with a memory for what it has encoded.

    A byte-level tokenizer with the usual pattern never joins what stands on both sides of a white space's begin, or of a stop
    behind an ASCII letter or digit. So its texts are cut there, and units that occurred before are looked up. Any other tokenizer
    gets whole texts, and so does a text with the string of an added token.
    """

    #: A run of white space and what follows up to a cut. Where other white space than ASCII stands, units are longer.
    UNIT = re.compile(r"[ \t-\r]*(?:[A-Za-z0-9]+(?=[,.;:!?])|[^ \t-\r]+)|[ \t-\r]+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        pre = told.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.cuts = plain and told.get("normalizer") is None and told["model"]["type"] == "BPE"
        added = [re.escape(x["content"]) for x in told.get("added_tokens", ())]
        self.added = re.compile("|".join(added)) if added else None
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.uint16 if largest < 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.size = _Numbers(), np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.kind, int(size.sum())), size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > KNOWN_UNITS:
            self._forget()
        whole = [not self.cuts or bool(self.added and self.added.search(x)) for x in texts]
        units = [[] if w else self.UNIT.findall(x) for w, x in zip(whole, texts, strict=True)]
        count = np.array([0, *map(len, units)])
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(units)), np.int64, count.sum())
        if self.numbers.new:
            flat, size = self._encoded(self.numbers.new)
            self.flat, self.size, self.numbers.new = np.concatenate([self.flat, flat]), np.concatenate([self.size, size]), []
        begin, size = np.cumsum(self.size) - self.size, self.size[at]
        ids = self.flat[ragged(begin[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count)]
        out = [ids[a:b] for a, b in itertools.pairwise(ends)]
        for i in np.flatnonzero(whole):
            out[i] = self._encoded([texts[i]])[0]
        return out


def encode_texts(page_texts: DataFrame, tokenizer: str, end_id: int | None, page_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page, row, wide, ids): the ids of each text, packed as numbers of 16 or 32 (``wide``) bits, and ``end_id`` behind them."""
    rows = page_texts.select(F.col(page_col).alias("page"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("page").schema.add("row", "long").add("wide", "boolean").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, coder = TaskContext.get().partitionId() << 40, Coder(tokenizer)
        kind = np.uint32 if end_id is not None and end_id >= 1 << 16 else coder.kind
        tail = np.array([] if end_id is None else [end_id], kind)
        for batch in batches:
            for piece in pieces(batch, "text", SLICE_BYTES):
                n = piece.num_rows
                packed = [pack(np.concatenate([x, tail])) for x in coder.encode(piece.column("text").to_pylist())]
                wide = pa.array(np.full(n, kind is np.uint32))
                columns = [piece.column("page"), pa.array(row + np.arange(n)), wide, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                row += n

    return rows.mapInArrow(run, schema)


def _ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, blob in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
        yield unpack(blob.as_buffer(), np.uint32 if wide else np.uint16)


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. A task sends each id once, and what comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _ids_of(batch):
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = encoded.select("wide", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r.id for r in found), default=-1), np.int64)
    for row in found:
        out[row.id] = row.n
    return out


def write_token_files(
    page_texts: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 2,
    page_col: str = "page_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> None:
    """Write the token ids of all recognised texts, in the order of the pages, as coded files below ``folder``.

    ``page_texts``: (``page_id`` of any type that sorts, ``text``), one row per page; other columns are dropped. ``tokenizer``
    is the path of a file of the tokenizers library, the same on all machines; no special ids are added but ``end_id`` (if any)
    behind each text, and a special token's string in a text becomes what the tokenizer makes of it. A null text counts as empty.
    Rows without page_id come first; those with the same page_id follow each other in the order of a hash of their ids. A
    file ends with the page that fills ``file_ids`` ids, so a text has to fit a task's memory (about 200 times its size).
    Names of files below ``folder``/files sort like their pages; ``folder``/parts tells how many ids stand before each task's files. An empty
    table writes no ids. ``folder`` must not exist.
    """
    encoded = written(encode_texts(page_texts, tokenizer, end_id, page_col, text_col), "tokens-encoded")
    lengths = code_lengths(id_counts(encoded))
    # ranges also cut a page_id that very many rows share
    order = [F.col("page").asc_nulls_first(), F.xxhash64("ids"), F.col("row")]
    sorted_ = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("page", "wide", "ids")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, pages, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            n_tokens = np.array([len(x) for x in ids], np.int64)
            body = write_file(part, before, pa.concat_arrays(pages), n_tokens, np.concatenate(ids), lengths)
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["value"])

        for batch in batches:
            begin = 0
            for i, found in enumerate(_ids_of(batch)):
                ids.append(found)
                size += len(found)
                if size >= file_ids:
                    pages.append(batch.column("page").slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield file()
                    before, pages, ids, size = before + size, [], [], 0
            if begin < batch.num_rows:
                pages.append(batch.column("page").slice(begin))
        if ids:
            yield file()

    # a partition is a part, so the names of the files sort like their pages
    out = sorted_.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(f"{folder}/files")
    spark = page_texts.sparkSession

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [struct.unpack_from(HEAD, x.as_buffer())[1:4] for x in batch.column("content")]
            columns = [pa.array([x[0] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n_ids"])

    # where each part begins: one number for each task of the step before
    sizes = _files(spark, folder).mapInArrow(heads, "part bigint, n_ids bigint").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    bases, total = [], 0
    for row in sorted(sizes):
        bases.append((row.part, total))
        total += row.n
    spark.createDataFrame(bases, "part bigint, base bigint").coalesce(1).write.json(f"{folder}/parts")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/files").filter("length > 0").select("content")


def read_token_files(spark: SparkSession, folder: str, page_type: str = "bigint") -> DataFrame:
    """All pages of the files below ``folder``, decoded.

    Returns (page_id of ``page_type``, start, n_tokens, ids): ``start`` counts the ids of all pages before, ``ids`` holds the page's own as
    little-endian unsigned 32-bit numbers. A damaged file fails the job.
    """
    schema = f"page_id {page_type}, start bigint, n_tokens bigint, ids binary"

    base = {r.part: r.base for r in spark.read.schema("part bigint, base bigint").json(f"{folder}/parts").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer())
                ids, ends = file.ids().astype("<u4"), np.cumsum(file.n_tokens)
                raw = pa.Array.from_buffers(
                    pa.large_binary(),
                    len(ends),
                    [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids)],
                )
                start = pa.array(base[file.part] + file.before + ends - file.n_tokens)
                columns = [file.pages, start, pa.array(file.n_tokens), raw.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "start", "n_tokens", "ids"])

    return _files(spark, folder).mapInArrow(run, schema)
