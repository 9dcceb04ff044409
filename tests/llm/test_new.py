"""Token files, vector codes and the prefix trie against plain Python."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from scorelake.llm import codes, prefixes, token_files
from scorelake.llm.exchange import scratch
from scorelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def with_clashes(df):
    names = ("n", "total", "slot", "part", "start", "ids", "base", "last", "taken", "pos", "light", "hung", "parts", "x", "code", "error", "row", "file")
    return df.select("*", *(F.lit("x").alias(c) for c in names if c not in df.columns))


# token files


def huffman_cost(counts):
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("n", [2, 3, 40, 700])
def test_code_lengths_are_the_best(n):
    r = np.random.default_rng(n)
    counts = np.floor(r.pareto(0.7, n) + 1).astype(np.int64)
    free = token_files.code_lengths(counts, 40)
    assert (free.astype(np.int64) * counts).sum() == huffman_cost(counts)
    short = token_files.code_lengths(counts, max(1, (n - 1).bit_length()))
    assert short.max() <= max(1, (n - 1).bit_length()) and (2.0 ** -short.astype(float)).sum() <= 1


def test_limited_code_of_few_ids_against_all_codes():
    counts = np.array([50, 20, 9, 4, 2, 1])
    best = min(
        sum(c * x for c, x in zip(counts, lengths, strict=True))
        for lengths in itertools.product(range(1, 5), repeat=6)
        if sum(2.0**-x for x in lengths) <= 1
    )
    assert (token_files.code_lengths(counts, 4).astype(int) * counts).sum() == best


def test_canonical_words_are_free_of_prefixes():
    lengths = token_files.code_lengths(np.array([5, 0, 9, 1, 1, 30, 2]))
    words = [format(int(w), f"0{n}b") for w, n in zip(token_files.code_words(lengths), lengths, strict=True) if n]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    same = [(n, w) for n, w in zip(lengths, token_files.code_words(lengths), strict=True) if n]
    for n in {n for n, _ in same}:  # words of one length follow each other in the order of the ids
        mine = [int(w) for k, w in same if k == n]
        assert mine == list(range(mine[0], mine[0] + len(mine)))


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_file_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.pareto(0.4, n) * 3, 49999).astype(np.uint32)
    lengths = token_files.code_lengths(np.bincount(ids))
    raw = token_files.write_file(3, 77, pa.array(["a", None]), np.array([1, n - 1]), ids, lengths) + token_files.END.encode()
    file = token_files.TokenFile(raw)
    assert (file.ids() == ids).all() and (file.part, file.before) == (3, 77) and file.pages.to_pylist() == ["a", None]
    for first, count in ((0, 1), (n // 2, n - n // 2), (n - 1, 1), (min(300, n - 1), 1)):
        assert (file.ids(first, count) == ids[first : first + count]).all()
    with pytest.raises(token_files.TokenFileError):
        token_files.TokenFile(raw[:-9] + raw[-8:])
    with pytest.raises(IndexError):
        file.ids(n, 1)


def slow_tokens(rows):
    coder = tokenizers.Tokenizer.from_file(BPE)
    made = [(p is not None, p or 0, coder.encode(t or "", add_special_tokens=False).ids + [2]) for p, t in rows]
    out, start = [], 0
    for some, page, ids in sorted(made, key=lambda x: x[:2]):
        raw = np.array(ids, "<u4").tobytes()
        out.append((page if some else None, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(9, "same"), (9, "same"), (4, None), (None, "no number"), (5, ""), (-3, "日本語 \U0001f600 <|endoftext|>"), (8, " \n\t "), (2**40, "x" * 9000)]
    rows += [(100 + i, " ".join(r.choice(["do", "re", "mi", "5", "|", "4/4"]) for _ in range(r.randint(0, 900)))) for i in range(40)]
    df = with_clashes(spark.createDataFrame(rows, "page_id bigint, text string").repartition(5))
    folder = scratch(spark, "test-tokens")
    token_files.write_token_files(df, folder, BPE, file_ids=3000)
    back = token_files.read_token_files(spark, folder).collect()
    got = sorted([(x.page_id, x.start, x.n_tokens, zlib.crc32(x.ids)) for x in back], key=lambda x: x[1])
    assert got == slow_tokens(rows)
    at = os.path.join(folder.removeprefix("file:"), "files")
    raw = [open(os.path.join(at, f), "rb").read() for f in sorted(os.listdir(at)) if f.startswith("part")]
    found = [token_files.TokenFile(x) for x in raw if x]
    places = [(f.part, f.before) for f in found]
    assert len(found) > 3 and places == sorted(places)
    assert [p for f in found for p in f.pages.to_pylist()] == [x[0] for x in slow_tokens(rows)]


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_UNITS", 40)
    whole = tokenizers.Tokenizer.from_file(BPE)
    coder = token_files.Coder(BPE)
    assert coder.cuts
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x0b", "\x1c", "\x85", "a", "don't", "'s", "it's", "12", "3.5", "日本", "é", "!?", "\U0001f600", "<|endoftext|>", "X'll"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(9)]
        got = coder.encode(texts)
        assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_an_empty_table(spark):
    folder = scratch(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame([], "page_id bigint, text string"), folder, BPE)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_token_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == slow_tokens(rows)


# vector codes


def test_limb_products_are_exact():
    r = np.random.default_rng(4)
    for size in (10, 2**20, 2**27 - 1):
        a, b = r.integers(-size, size + 1, (3, 50, 5)), r.integers(-size, size + 1, (3, 5, 7))
        a[0, 0], b[0, :, 0] = -size, -size
        want = (a.astype(object)[:, :, :, None] * b.astype(object)[:, None]).sum(axis=2)
        assert (codes.exact_products(a, b) == want).all()
    for values in (np.array([0, -1, 1, 5, -(2**40), 2**40 + 3]), np.zeros(0, np.int64)):
        parts = codes.limbs(values, 13)
        assert (sum(p.astype(np.int64) << (13 * i) for i, p in enumerate(parts)) == values).all()


def slow_codes(rows, parts, entries, rounds):
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) and abs(x * 256) < 2**27 for x in v)]
    common = max(((sum(len(w) == n for _, w, _ in good), n) for n in {len(v) for _, v, _ in good}), default=(0, 0))[1]
    good = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (-common % parts), lab) for i, v, lab in good if len(v) == common]
    good.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = -(-common // parts)
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in good]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    errors = {}
    for (_, _, lab), f in zip(good, found, strict=True):
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in f)
    codes_ = [(i, bytes(k for _, k in f), sum(d for d, _ in f), errors[lab]) for (i, _, lab), f in zip(good, found, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(codes_, key=str), digest


def made(result):
    return sorted(((r.vec_id, bytes(r.code), r.error, r.label_error) for r in result.codes.collect()), key=str)


@pytest.mark.parametrize(("parts", "entries", "size"), [(2, 4, 6), (3, 5, 7), (4, 64, 8)])
def test_vector_codes(spark, parts, entries, size):
    r = random.Random(parts)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25, 3.0, r.gauss(0, 1)]) for _ in range(size)], r.choice([1, 2, None])) for i in range(70)]
    rows += [(70, None, 1), (71, [], 1), (72, [float("nan")] * size, 1), (73, [1.0] * (size - 1) + [None], 1), (74, [float("inf")] * size, 2)]
    rows += [(75, [1.0], 1), (3, rows[3][1], 2), (3, rows[4][1], 2), (None, rows[5][1], None), (76, [1e9] * size, 1), (77, [-500000.0] * size, 1)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4))
    got = codes.vector_codes(df, parts=parts, entries=entries)
    want, digest = slow_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], parts, entries, 2)
    assert made(got) == want and got.digest() == digest


def test_vector_codes_of_equal_and_no_vectors(spark, monkeypatch):
    rows = [(i, [1.0, -1.0], i % 3) for i in range(9)]
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    got = codes.vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), parts=2, entries=4)
    assert made(got) == [(i, b"\0\0", 0, 0) for i in range(9)] and got.codebooks.tolist() == [[[256]] * 4, [[-256]] * 4]
    for none in ([], [(1, None, 1)]):
        got = codes.vector_codes(spark.createDataFrame(none, "vec_id bigint, embedding array<double>, label int"))
        assert got.codes.count() == 0 and got.codebooks.size == 0


# prefix trie


def slow_trie(lines, editions):
    own = {}
    for score, line, role, text in lines:
        if score is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(score, []).append(((line is not None, line or 0), role, digest, text))
    own = {s: [(role, text) for _, role, _, text in sorted(x)] for s, x in own.items()}
    rebuilt = {}
    for score, base, head in sorted(editions, key=lambda e: (e[0] or 0, e[1] is not None, e[1] or 0, e[2] or 0)):
        if score is not None and score not in rebuilt:
            head = max(head or 0, 0)
            rebuilt[score] = tuple(own.get(base, [])[:head] + own.get(score, [])[head:])
    nodes = {}
    for score, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(score)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(str(s) for s in sorted(members) if len(rebuilt[s]) == len(p))
        above = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), above, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, lines, editions, **more):
    lines = with_clashes(spark.createDataFrame(lines, "score_id bigint, line_idx bigint, role string, text string").repartition(4))
    editions = with_clashes(spark.createDataFrame(editions, "score_id bigint, base_id bigint, head int"))
    got = prefixes.score_prefix_trie(lines, editions, **more)
    nodes = got.nodes.join(prefixes.ends_digests(got.ends), "node_id", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(
        ((r.score_id, r.depth, r.parent_score_id, r.n_scores, r.n_children, r.n_leaves, r.saved_words, r.ends_sha256 or empty) for r in nodes), key=str
    )


def invented(seed, n):
    r = random.Random(seed)
    words = ["1 2 3", "5 - 6", "| 1", "la la", ""]
    lines = [(s, i, r.choice(["notes", "lyrics"]), r.choice(words)) for s in range(n) for i in range(r.choice([0, 1, 2, 3, 8]))]
    lines += [(s, i, x, t) for s, (i, x, t) in itertools.product([200, 201, 202], [(0, "notes", "1 1"), (1, "notes", "2 2"), (2, None, None), (2, "notes", "x")])]
    lines += [(200, None, "title", "first"), (None, 0, "notes", "lost"), (203, 1, "notes", "1"), (203, 1, "notes", "1"), (-7, 5, "notes", "1 2 3")]
    editions = [(s, s - s % 4, r.randint(0, 4)) for s in range(n)] + [(200, None, 2), (201, 200, 2), (202, 200, 9), (203, 999, 1), (-7, 203, 1), (None, 1, 1)]
    return lines, editions + [(5, 4, 2), (300, 301, 2), (204, 202, None), (205, 202, -1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed):
    lines, editions = invented(seed, 40)
    assert trie(spark, lines, editions) == slow_trie(lines, editions)


def test_prefix_trie_survives_colliding_fingerprints(spark, monkeypatch):
    """With few residues many prefixes meet in one group; the check on their references sees it and other moduli are taken."""
    lines, editions = invented(4, 12)
    calls, nodes = [], prefixes._nodes

    def watched(members):
        calls.append(1)
        if len(calls) == 1:
            members = members.withColumns({c: F.lit(7).cast("long") for c in ("u", "v")})
        return nodes(members)

    monkeypatch.setattr(prefixes, "_nodes", watched)
    assert trie(spark, lines, editions) == slow_trie(lines, editions) and len(calls) == 2


def test_prefix_trie_of_chains_and_nothing(spark):
    lines = [(s, i, "notes", "1 2") for s in range(12) for i in range(s)] + [(50, i, "notes", str(i)) for i in range(40)]
    editions = [(s, None, 0) for s in [*range(12), 50]]
    assert trie(spark, lines, editions) == slow_trie(lines, editions)
    assert trie(spark, [], []) == []
    assert trie(spark, [], [(1, 1, 3), (2, None, 0)]) == slow_trie([], [(1, 1, 3), (2, None, 0)])


def test_prefix_trie_with_a_hot_score(spark, monkeypatch):
    from scorelake.plans import skew

    lines, editions = invented(3, 20)
    lines += [(400, i, "notes", str(i % 3)) for i in range(300)]
    editions += [(400, 200, 1), (401, 400, 2)]
    monkeypatch.setattr(skew, "SCAN_ROWS", 60)
    assert trie(spark, lines, editions) == slow_trie(lines, editions)
