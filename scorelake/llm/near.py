"""Near-duplicate pages by DartMinHash signatures of weighted word shingles.

A text is the multiset of its shingles; a shingle's weight is how often it occurs. Over each unit of weight of each
shingle lies a stream of hashed darts, at random ranks and coordinates, the same in every text. A text throws the darts
that fall into its own weight regions up to a rank that suffices for its total weight, and keeps the earliest dart of each
coordinate. Two texts agree at a coordinate with the probability of their weighted Jaccard similarity.
Bands of coordinates propose partners; every link is verified on the whole shingle multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.arrays import Words, buffers, combined, mix, pieces
from scorelake.llm.exchange import passing, written

SLICE_BYTES = 1 << 20
#: How often the pages of a bucket are compared with one page of a drawn class, at most; the comparisons end earlier once fewer
#: than one in TURN_LINKS of them links. What they leave apart is searched exactly.
TURNS, TURN_LINKS = 8, 20
#: Bits of a text's marks in the exact search.
BITS = 1024
#: Shingles before a common one that are looked through for another common one.
BEFORE = 16


def shingle_elements(words: Words, size: int, digests: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every unit of weight, sorted: the j-th occurrence of a shingle in a text has a key of its own.

    A text of fewer than ``size`` words, but one at least, has one shingle of all its words. ``digests``: of ``words``.
    """
    at, key = words.windows(size, words.hashes())
    text = words.text[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([int.from_bytes(digests[i][:8], "little") for i in short], np.uint64)
        text, key = np.concatenate([text, short]), np.concatenate([key, whole])
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    turn = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    key = np.where(turn > 0, mix(key + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7), key)
    return text, key


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def dart_signatures(text: np.ndarray, key: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n, size) of uint64; zeros for a text without elements. ``key``: one for each unit of weight."""
    weight = np.bincount(text, minlength=n)
    out = np.zeros((n, size), np.uint64)
    reach = size * (np.log(size) + 3) / np.maximum(weight, 1)  # darts up to this rank fill nearly all coordinates
    todo = weight > 0
    while todo.any():
        mine = todo[text]
        k, t = key[mine], text[mine]
        cells, ranks, darts = [], [], []
        rank, turn = np.zeros(len(k)), 0
        while len(k):  # the next dart of each unit, as long as one is in reach
            dart = mix(k, 100 + turn)
            rank = rank - np.log(_uniform(dart))
            near = rank <= reach[t]
            k, t, rank, dart = k[near], t[near], rank[near], dart[near]
            dart = mix(dart, 11)
            cells.append(t * size + ((dart >> np.uint64(32)) % np.uint64(size)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
            turn += 1
        cell, rank, dart = np.concatenate(cells), np.concatenate(ranks), np.concatenate(darts)
        late = np.argsort(-rank, kind="stable")
        found = np.zeros(n * size, np.uint64)
        found[cell[late]] = dart[late]  # the earliest is written last
        filled = np.zeros(n * size, bool)
        filled[cell] = True
        full = filled.reshape(n, size).all(axis=1) & todo
        out[full] = found.reshape(n, size)[full]
        todo &= ~full
        reach = np.where(todo, 2 * reach, reach)
    return out


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    n, size = signatures.shape
    parts = mix(signatures.reshape(n, bands, size // bands), 13)
    out = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 14), (n, bands))
    for row in range(size // bands):
        out = combined(out, parts[:, :, row])
    return out


def signatures_of(page_texts: DataFrame, bands: int, rows: int, shingle: int, page_col: str, text_col: str) -> DataFrame:
    """(page_id, key, bands): ``key`` is the same for texts of the same words and null for texts without words."""
    source = page_texts.select(F.col(page_col).alias("page_id"), F.col(text_col).alias("text"))
    schema = source.drop("text").schema.add("key", T.BinaryType()).add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SLICE_BYTES):
                words = Words(*buffers(piece.column("text")))
                n, digests = piece.num_rows, words.digests()
                key = pa.array(digests, pa.binary())
                signature = dart_signatures(*shingle_elements(words, shingle, digests), n, bands * rows)
                flat = pa.array(band_hashes(signature, bands).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), key, lists], names=["page_id", "key", "bands"])

    return source.mapInArrow(run, schema)


def _shingle_keys(texts: DataFrame, shingle: int) -> DataFrame:
    """(page_id, keys): the sorted keys of ``shingle_elements`` of each text, packed."""
    schema = texts.select("page_id").schema.add("keys", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SLICE_BYTES):
                words = Words(*buffers(piece.column("text")))
                text, key = shingle_elements(words, shingle, words.digests())
                key = key[np.lexsort((key, text))]
                ends = np.searchsorted(text, np.arange(piece.num_rows + 1))
                rows = [key[ends[i] : ends[i + 1]].tobytes() for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), pa.array(rows, pa.binary())], names=["page_id", "keys"])

    return texts.mapInArrow(run, schema)


def _measured(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``common`` and ``either``: the weight of the shingles in both texts, and in one or both."""
    schema = pairs.select("a", "b").schema.add("common", "long").add("either", "long")
    sides = pairs.select("a", "b").join(keys.select(F.col("page_id").alias("b"), F.col("keys").alias("kb")), "b")
    sides = sides.join(keys.select(F.col("page_id").alias("a"), F.col("keys").alias("ka")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, either = [], []
            for ka, kb in zip(batch.column("ka"), batch.column("kb"), strict=True):
                a, b = np.frombuffer(ka.as_buffer(), np.uint64), np.frombuffer(kb.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")  # two sorted runs: a merge
                same = int((both[1:] == both[:-1]).sum())
                common.append(same)
                either.append(len(both) - same)
            arrays = [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "common", "either"])

    return sides.select("a", "b", "ka", "kb").mapInArrow(run, schema)


def _possible_pairs(rest: DataFrame, keys: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of ``rest`` (page_id, label) in different classes that may be similar: a superset of the similar ones.

    Shingles are ordered from rare to frequent. Similar texts share one of the first shingles of both (as many as may
    differ, and one), and what follows the first shared one bounds all they have in common; so does, more closely, what
    follows the last one shared among these. Among many copies with edits of their own the edits come first, so nearly
    all pairs fall to these bounds. A third bound holds where the rare shingles are shared by chance: a text carries a bit
    for each of its shingles, by hash, and every bit that only one of two texts has stands for a shingle that the other lacks.
    """
    over, under = similarity
    schema = rest.schema.add("token", "long").add("n", "integer")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = np.frombuffer(batch.column("keys")[i].as_buffer(), np.int64)
                ids = batch.select(["page_id", "label"]).take(pa.array(np.full(len(key), i)))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(key), pa.array(np.full(len(key), len(key), np.int32))], names=schema.names)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, BITS // 64), np.uint64)
            for i in range(batch.num_rows):
                bit = mix(np.frombuffer(batch.column("keys")[i].as_buffer(), np.uint64), 21) % np.uint64(BITS)
                np.bitwise_or.at(rows[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (BITS // 64))
            lists = pa.ListArray.from_arrays(ends, pa.array(rows.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), lists], names=["page_id", "bits"])

    texts = rest.join(keys, "page_id").select("page_id", "label", "keys").dropDuplicates(["page_id"])
    texts = written(texts, "near-texts")
    words = written(texts.mapInArrow(tokens, schema), "near-tokens")
    marks = texts.select("page_id", "keys").mapInArrow(bits, rest.select("page_id").schema.add("bits", T.ArrayType(T.LongType())))
    counts = words.groupBy("token").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("page_id").orderBy("texts", "token")
    ranked = words.join(counts, "token").withColumn("at", F.row_number().over(order) - 1)
    # a pair comes out at its first common token: not where one of the tokens just before is common, too
    before = F.collect_list(F.when(F.col("texts") > 1, F.col("token"))).over(order.rowsBetween(-BEFORE, -1))
    ranked = ranked.withColumn("before", before).filter(F.col("at") * under <= F.col("n") * (under - over)).join(marks, "page_id")
    head = written(ranked, "near-heads")
    first = head.filter("texts > 1")
    left = first.select("token", F.col("page_id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("bits").alias("ba"), F.col("before").alias("qa"))
    right = first.select("token", F.col("page_id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("bits").alias("bb"), F.col("before").alias("qb"))
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, c: n + c)
    most = F.least(F.col("na") - F.greatest("pa", alone("ba", "bb")), F.col("nb") - F.greatest("pb", alone("bb", "ba")))
    may = most * (over + under) >= (F.col("na") + F.col("nb")) * over
    met = left.join(right, "token").filter((F.col("la") < F.col("lb")) & may & ~F.arrays_overlap("qa", "qb"))
    met = met.select(F.greatest("a", "b").alias("p"), F.least("a", "b").alias("q")).distinct()
    lists = head.groupBy("page_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("h"))
    lists = lists.select("page_id", "n", F.transform("h", lambda x: x["token"]).alias("h"))
    one = lists.select(F.col("page_id").alias("p"), F.col("n").alias("np"), F.col("h").alias("hp"))
    two = lists.select(F.col("page_id").alias("q"), F.col("n").alias("nq"), F.col("h").alias("hq"))
    both = met.join(one, "p").join(two, "q").withColumn("same", F.array_intersect("hp", "hq"))
    both = both.withColumns({"last": F.element_at("same", -1), "n_same": F.size("same")})
    rest_of = lambda n, h: F.col(n) - F.array_position(h, F.col("last"))
    most = F.col("n_same") + F.least(rest_of("np", "hp"), rest_of("nq", "hq"))
    both = both.filter(most * (over + under) >= (F.col("np") + F.col("nq")) * over)
    return both.select(F.col("p").alias("a"), F.col("q").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node that it is linked to, directly or not.

    Labels spread over the edges and jump along labels, so rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "near-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        least = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = written(least.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "near-labels")
        labels = after.select("node", "label")
        if after.filter("label < old").isEmpty():
            return labels


def _linked(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links ``edges`` (a, b) too: only links between classes are followed."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), "label")
        edges = edges.join(own, side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    between = written(edges.filter("a <> b").distinct(), "near-links")
    if between.isEmpty():
        return labels
    top = components(between)
    new = top.select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = labels.join(new, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return written(known.union(top.join(labels, "node", "left_anti").select("node", "label")), "near-labels")


def _classes(
    page_texts: DataFrame, member: DataFrame, similarity: tuple[int, int], shingle: int, page_col: str, text_col: str
) -> DataFrame:
    """(node, label): the class of each page of ``member`` that is linked to another, the smallest of the class."""
    over, under = similarity
    banded = member.filter("bands is not null").select(F.col("rep").alias("a"), F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("a").alias("leader"), F.max("a").alias("last")).filter("last > leader").drop("last")
    buckets = written(banded.join(groups, "band").distinct(), "near-buckets")
    wanted = buckets.select(F.col("a").alias("page_id")).distinct()
    texts = page_texts.select(F.col(page_col).alias("page_id"), F.col(text_col).alias("text")).join(wanted, "page_id", "left_semi")
    keys = written(_shingle_keys(texts, shingle), "near-keys")

    similar = F.col("common") * under >= F.col("either") * over
    first = written(_measured(buckets.filter("a <> leader").select("a", F.col("leader").alias("b")).distinct(), keys), "near-pairs")
    labels = components(first.filter(similar).select("a", "b"))

    def in_classes(labels: DataFrame) -> DataFrame:
        """Rows (band, a) of ``buckets`` with their class, in buckets of several classes."""
        named = buckets.join(labels.withColumnRenamed("node", "a"), "a", "left").select("band", "a", F.coalesce("label", "a").alias("label"))
        mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        return named.join(mixed.select("band"), "band", "left_semi")

    known = first.select("a", "b")
    for turn in range(TURNS):
        mixed = written(in_classes(labels), "near-mixed")
        pivot = mixed.groupBy("band").agg(F.min(F.struct(F.xxhash64("label", F.lit(turn)).alias("h"), "label", "a")).alias("pivot"))
        pairs = mixed.join(pivot, "band").filter(F.col("label") != F.col("pivot.label")).select("a", F.col("pivot.a").alias("b")).distinct()
        again = written(_measured(pairs.join(known, ["a", "b"], "left_anti"), keys), "near-pairs")
        found = again.agg(F.count("*").alias("pairs"), F.count_if(similar).alias("links")).first()
        labels = _linked(labels, again.filter(similar).select("a", "b"))
        known = known.union(again.select("a", "b"))
        if TURN_LINKS * found.links < found.pairs or not found.pairs:
            break

    rest = written(in_classes(labels).select(F.col("a").alias("page_id"), "label").distinct(), "near-rest")
    pairs = _possible_pairs(rest, keys, similarity)
    third = written(_measured(pairs.join(known, ["a", "b"], "left_anti"), keys), "near-pairs")
    labels = _linked(labels, third.filter(similar).select("a", "b"))
    return labels


def near_duplicates(
    page_texts: DataFrame,
    similarity: tuple[int, int] = (4, 5),
    bands: int = 24,
    rows: int = 5,
    shingle: int = 5,
    page_col: str = "page_id",
    text_col: str = "text",
) -> DataFrame:
    """Classes of pages whose recognised texts are copies or near copies of each other.

    ``page_texts``: (``page_id`` of an integer type, ``text``), one row per page; other columns are dropped. Two pages are
    linked if the weighted Jaccard similarity of their shingles of ``shingle`` words (a text with fewer words is one
    shingle) is ``similarity`` (a fraction) or more; a class is what links connect. Texts of the same words form one node.

    Returns (page_id, class_id), one row per row of ``page_texts``; ``class_id`` is the smallest page_id of the class. Null
    and empty texts have no shingles and stand alone, under their own id. A page listed twice is in its class twice (with two texts, the
    classes of both are one). A null
    page_id is in the class of the pages with its words, or has a null class. An empty table gives an empty result.

    How partners are found: pages that share one of ``bands`` bands of ``rows`` coordinates form a bucket; at the default a pair
    of similarity 0.8 shares one with probability 0.9999. In a bucket all pages are compared with the smallest page, then
    some times with a page of a class drawn by hash, as long as that links classes: so a large group of near copies becomes
    one class in few comparisons. Pages of buckets that still hold several classes are then searched
    exactly for similar pairs (``_possible_pairs``). So no cap drops a partner.
    """
    with passing(page_texts.sparkSession, "near"):
        signed = written(signatures_of(page_texts, bands, rows, shingle, page_col, text_col), "near-signatures")
        owners = signed.filter("key is not null").groupBy("key").agg(F.min("page_id").alias("rep"))
        # written, as AQE splits a large group of copies (on the left side) only beside a plain scan
        owners = written(owners, "near-owners")
        member = signed.join(owners, "key", "left").select("page_id", "rep", F.when(F.col("page_id") == F.col("rep"), F.col("bands")).alias("bands"))
        member = written(member, "near-members", stays=True)
        labels = written(_classes(page_texts, member, similarity, shingle, page_col, text_col), "near-classes", stays=True)
    return member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("page_id").alias(page_col), F.coalesce("label", "rep", "page_id").alias("class_id")
    )
