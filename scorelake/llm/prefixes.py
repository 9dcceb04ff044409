"""Prefix trie of score editions, by fingerprints that compose.

An edition takes the first lines of its base score and goes on with its own. The fingerprint of a run of lines is a sum of
line values times powers of a base, so that of an edition's prefix follows from those of the base's head and of the
edition's own lines: one is added to the other, shifted by the places the head is longer or shorter. No edition is ever
written out; every line is stored once, as a reference with its digest. Equal prefixes meet by depth and fingerprint, and a
group counts as one node only if all its references hold the same digest and lead to the same node above.

Sums over subtrees need no walk: every node belongs to the path that goes on to its most shared child, an edition leaves at
most a logarithmic number of such paths, and what hangs below a path is added where it leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.exchange import written
from scorelake.llm.rules import WORD_BREAK
from scorelake.plans.skew import attach_row, ordered

#: The four largest primes below 2**31: products fit 64 bits. Fixed values.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Hexadecimal digits of the digest that give a line's value modulo each prime.
DIGITS = 15
NODE = ("depth", "u", "v")


@dataclass(frozen=True)
class PrefixTrie:
    """``nodes`` and, for each node at which editions end, these editions as ``ends`` (node_id, score_id)."""

    nodes: DataFrame
    ends: DataFrame


def _bases(seed: int) -> tuple[int, ...]:
    raw = hashlib.sha256(f"prefixes {seed}".encode()).digest()
    return tuple(2 + int.from_bytes(raw[8 * i : 8 * i + 8], "big") % (p - 3) for i, p in enumerate(PRIMES))


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent modulo prime for an exponent of up to 31 bits, by the squares of the base."""
    squares = F.array(*(F.lit(pow(base, 1 << k, prime)).cast("long") for k in range(31)))
    step = lambda acc, k: F.when(F.getbit(exponent.cast("long"), k) == 1, acc * F.element_at(squares, k + 1) % prime).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(1).cast("long"), step)


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])


def _lines(score_lines: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """(score_id, at, role, digest, words): lines as references; texts go no further than this."""
    score, line, role, text = names
    rows = score_lines.filter(F.col(score).isNotNull()).select(
        F.col(score).alias("score_id"),
        F.col(line).alias("at"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    words = F.size(F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
    return rows.select("score_id", "at", "role", digest.alias("digest"), words.cast("long").alias("words"))


def _own_prefixes(lines: DataFrame, seed: int) -> DataFrame:
    """Lines numbered by ``pos``, with the sums of their score before (b0 ..) and through (s0 ..) each of them."""
    bases = _bases(seed)
    value = lambda k: F.conv(F.substring("digest", 1 + DIGITS * k, DIGITS), 16, 10).cast("long") % PRIMES[k]
    terms = lines.withColumns({f"t{k}": value(k) * _power(bases[k], F.col("pos"), p) % p for k, p in enumerate(PRIMES)})
    sums = ordered(terms, ["score_id"], ["pos"], sums={f"b{k}": F.col(f"t{k}") for k in range(4)})
    before = {f"b{k}": F.col(f"b{k}") % p for k, p in enumerate(PRIMES)}
    through = {f"s{k}": (F.col(f"b{k}") + F.col(f"t{k}")) % p for k, p in enumerate(PRIMES)}
    return sums.select("score_id", "pos", "digest", "words", *(c.alias(n) for n, c in (before | through).items()))


def _members(own: DataFrame, editions: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """All prefixes of all editions as (score_id, depth, u, v, pu, pv, digest, words, last), and (score_id, n) of all editions."""
    size = own.groupBy("score_id").agg(F.max("pos").cast("long").alias("n"))
    plan = editions.join(size, "score_id", "left").join(size.select(F.col("score_id").alias("base_id"), F.col("n").alias("n_base")), "base_id", "left")
    plan = plan.withColumns({"n": F.coalesce("n", F.lit(0)), "taken": F.least("head", F.coalesce("n_base", F.lit(0)))})
    at = lambda name, pos, to: own.select(F.col("score_id").alias(name), F.col("pos").cast("long").alias(pos), *(F.col(f"s{k}").alias(f"{to}{k}") for k in range(4)))
    plan = plan.join(at("base_id", "taken", "h"), ["base_id", "taken"], "left").join(at("score_id", "head", "o"), ["score_id", "head"], "left")
    plan = plan.withColumns({f"{c}{k}": F.coalesce(f"{c}{k}", F.lit(0)).cast("long") for c in "ho" for k in range(4)})
    plan = written(plan.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "prefixes-plan")

    # the head: prefixes of the base as they are
    base = own.withColumnRenamed("score_id", "base_id")
    heads = plan.filter("taken > 0").select("score_id", "base_id", "taken", "total").join(base, "base_id").filter("pos <= taken")
    u, v = _packed([F.col(f"s{k}") for k in range(4)])
    pu, pv = _packed([F.col(f"b{k}") for k in range(4)])
    columns = lambda depth, u, v, pu, pv: ["score_id", depth.cast("long").alias("depth"), u.alias("u"), v.alias("v"), pu.alias("pu"), pv.alias("pv"), "digest", "words", (depth == F.col("total")).alias("last")]
    heads = heads.select(*columns(F.col("pos"), u, v, pu, pv))

    # the rest: own lines behind the head, moved by what the head is shorter than the lines it stands for
    rest = own.join(plan.drop("n", "base_id", "n_base"), "score_id").filter("pos > head")
    shift = [_power(pow(b, -1, p), F.col("head") - F.col("taken"), p) for b, p in zip(_bases(seed), PRIMES, strict=True)]
    rest = rest.withColumns({f"m{k}": shift[k] for k in range(4)})
    moved = lambda c: _packed([(F.col(f"h{k}") + F.pmod(F.col(f"{c}{k}") - F.col(f"o{k}"), F.lit(p)) * F.col(f"m{k}")) % p for k, p in enumerate(PRIMES)])
    rest = rest.select(*columns(F.col("taken") + F.col("pos") - F.col("head"), *moved("s"), *moved("b")))
    return written(heads.union(rest), "prefixes-members"), plan.select("score_id", F.col("total").alias("n"))


def _nodes(members: DataFrame) -> tuple[DataFrame, bool]:
    """Groups of equal prefixes, and whether each of them is one node beyond doubt."""
    same = [F.min("digest") == F.max("digest"), F.min("pu") == F.max("pu"), F.min("pv") == F.max("pv")]
    groups = members.groupBy(*NODE).agg(
        F.min("score_id").alias("score_id"),
        F.count(F.lit(1)).alias("n_scores"),
        F.min("words").alias("words"),
        F.min("pu").alias("pu"),
        F.min("pv").alias("pv"),
        (same[0] & same[1] & same[2]).alias("one"),
    )
    groups = written(groups, "prefixes-groups")
    return groups.drop("one"), groups.filter(~F.col("one")).isEmpty()


def score_prefix_trie(
    score_lines: DataFrame,
    editions: DataFrame,
    score_col: str = "score_id",
    line_col: str = "line_idx",
    role_col: str = "role",
    text_col: str = "text",
    seed: int = 0,
) -> PrefixTrie:
    """The trie of the line sequences of all score editions.

    ``score_lines``: (``score_id`` of an integer type, ``line_idx``, ``role``, ``text``), the lines of scores in the order of
    ``line_idx`` (null first; ties by role and by a hash of the text). Null roles and texts count as empty; rows of a null
    score are left out. ``editions``: (``score_id``, ``base_id``, ``head``), one row for each edition: its lines are the
    first ``head`` lines of the base (all if there are fewer, none if the base is null or has none), then its own lines behind its first
    ``head``. A null or negative head is 0. Rows of a null or repeated edition are left out (of several, the smallest row
    stays). Scores without an edition only serve as bases. Other columns are dropped.

    ``nodes``: one row for each distinct sequence of first lines, the empty one (depth 0) too if there is an edition:
    (node_id, score_id, depth, parent_score_id, n_scores, n_children, n_leaves, saved_words). ``score_id`` is the smallest
    edition that begins so, ``parent_score_id`` that of the node above (null at depth 0), ``n_scores`` the number of such editions,
    ``n_leaves`` the childless nodes in the subtree (the top included), and ``saved_words`` sums, over the subtree, the words
    of each node's last line times its editions but one. ``ends`` are the editions that end at a node.
    Empty tables give empty results.

    Prefixes are grouped by 124 bits. A group is a node if the SHA-256 of its last lines and the groups above agree; if any
    doesn't, all fingerprints are made again with other bases.
    """
    clean = editions.filter(F.col(score_col).isNotNull()).select(
        F.col(score_col).alias("score_id"), F.col("base_id"), F.greatest(F.coalesce(F.col("head").cast("long"), F.lit(0)), F.lit(0)).alias("head")
    )
    clean = clean.groupBy("score_id").agg(F.min(F.struct("base_id", "head")).alias("e")).select("score_id", "e.*")
    lines = _lines(score_lines, (score_col, line_col, role_col, text_col))
    lines = written(ordered(lines, ["score_id"], ["at", "role", "digest"], number="pos").drop("at", "role"), "prefixes-lines")
    while True:
        own = written(_own_prefixes(lines, seed), "prefixes-own")
        members, totals = _members(own, clean, seed)
        groups, sure = _nodes(members)
        if sure:
            break
        seed += 1
    root = totals.agg(F.min("score_id").alias("score_id"), F.count(F.lit(1)).alias("n_scores"))
    root = root.filter("n_scores > 0").select(*(F.lit(0).cast("long").alias(c) for c in NODE), "score_id", "n_scores", F.lit(0).cast("long").alias("words"))
    nodes = written(_measured(groups, members, root), "prefixes-nodes")
    name = F.md5(F.concat_ws(":", *NODE).cast("binary")).alias("node_id")
    ends = members.filter("last").select(name, "score_id").union(totals.filter("n = 0").select(F.md5(F.lit("0:0:0").cast("binary")), "score_id"))
    columns = [F.col("score_id").alias(score_col), "depth", F.col("parent_score_id").alias(f"parent_{score_col}"), "n_scores", "n_children", "n_leaves", "saved_words"]
    return PrefixTrie(nodes.select(name, *columns), ends.select("node_id", F.col("score_id").alias(score_col)))


def _measured(groups: DataFrame, members: DataFrame, root: DataFrame) -> DataFrame:
    """``groups`` and the root with the node above, the number of children and the sums over their subtrees."""
    above = F.struct(F.col("depth") - 1, "pu", "pv")
    rank = F.struct("n_scores", F.bitwise_not("score_id").alias("first"))  # the most shared child, of several the one of the smallest edition
    under = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v"))
    under = under.agg(F.count(F.lit(1)).alias("n_children"), F.max(rank).alias("heavy"))
    known = root.unionByName(groups.drop("pu", "pv")).join(under, list(NODE), "left")
    known = written(known.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "prefixes-known")
    parents = known.select(F.col("depth").alias("pd"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("score_id").alias("parent_score_id"), "heavy")
    child = groups.select(*NODE, "pu", "pv", "score_id", "n_scores", "words", (F.col("depth") - 1).alias("pd")).join(parents, ["pd", "pu", "pv"])
    leaf = known.filter("depth > 0").select(*NODE, (F.col("n_children") == 0).alias("leaf"))
    child = child.select(*NODE, "parent_score_id", "score_id", (rank != F.col("heavy")).alias("light"), ((F.col("n_scores") - 1) * F.col("words")).alias("own"))
    child = written(child.join(leaf, list(NODE)), "prefixes-children")

    # the way to each leaf, along the edition that stands for it
    ways = members.select("score_id", *NODE, "pu", "pv").join(child.filter("leaf").select("score_id").distinct(), "score_id")
    ways = written(ways.join(child.select(*NODE, "light", "own"), list(NODE)), "prefixes-ways")
    top = ways.groupBy("score_id").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(1)).alias("top"), F.max("depth").alias("end"))
    paths = written(ways.join(top, "score_id").filter("depth >= top"), "prefixes-paths")
    total = paths.groupBy("score_id").agg(F.sum("own").alias("total"))
    hung = ways.filter("light and depth > 1").join(total, "score_id")
    hung = hung.groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v"))
    hung = hung.agg(F.sum("total").alias("hung"), F.count(F.lit(1)).alias("hung_leaves"))
    sums = paths.join(hung, list(NODE), "left").select(
        "score_id",
        *NODE,
        (F.col("own") + F.coalesce("hung", F.lit(0))).alias("saved"),
        ((F.col("depth") == F.col("end")).cast("long") + F.coalesce("hung_leaves", F.lit(0))).alias("leaves"),
    )
    sums = ordered(sums, ["score_id"], [-F.col("depth")], sums={"saved_below": F.col("saved"), "leaves_below": F.col("leaves")})
    sums = sums.select(*NODE, (F.col("saved") + F.col("saved_below")).alias("saved_words"), (F.col("leaves") + F.col("leaves_below")).alias("n_leaves"))
    whole = child.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("saved_words"), F.greatest(F.count_if("leaf"), F.lit(1)).alias("n_leaves"))
    sums = sums.unionByName(attach_row(root.select(*NODE), whole))
    out = known.join(child.select(*NODE, "parent_score_id"), list(NODE), "left").join(sums, list(NODE))
    return out.select(*NODE, "score_id", "parent_score_id", "n_scores", "n_children", "n_leaves", "saved_words")


def ends_digests(ends: DataFrame, score_col: str = "score_id") -> DataFrame:
    """(node_id, ends_sha256): SHA-256 of the decimal numbers of the editions in ``ends``, ascending and joined by commas.

    Such a hash is one sequence, so a node's editions run through one task, but sorted on disk and a batch at a time.
    """
    rows = ends.select("node_id", F.col(score_col).cast("long").alias("score_id"))
    rows = rows.repartition("node_id").sortWithinPartitions("node_id", "score_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            names = batch.column("node_id")
            runs = pc.run_end_encode(names)
            begin, done = 0, []
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                text = ",".join(map(str, batch.column("score_id").slice(begin, end - begin).to_pylist()))
                begin = end
                if value == node:
                    state.update(f",{text}".encode())
                    continue
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = value, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([x for _, x in done])], names=["node_id", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node_id", "ends_sha256"])

    return rows.mapInArrow(run, "node_id string, ends_sha256 string")
