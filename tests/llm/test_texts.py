"""Text operators against plain Python: overlaps, passages, rules, quality, near copies, leaks."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import arrays, contamination, exchange, near, overlaps, passages, quality, rules
from scorelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pages(spark, rows, extra=True):
    """Rows (page_id, text) with columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows, "page_id bigint, text string").repartition(3)
    clash = ("chunk", "bucket", "body", "key", "bands", "label", "n_words", "base_failed", "stats", "score", "hash", "at", "n_removed", "ids")
    return df.select("*", *(F.lit("x").alias(c) for c in clash)) if extra else df


def invented(n, seed=5):
    """Texts with shared passages, repeats, copies and odd cases."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ñandú", "日本語", "a"]
    passage = [r.choice(vocab) for _ in range(90)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, " ".join(passage)), (4, " ".join(passage)), (5, "ab" * 400), (6, "a " * 300)]
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        if i % 3 == 0:
            at = r.randint(0, 40)
            words[r.randint(0, len(words)) : 0] = passage[at : at + r.randint(20, 50)]
        text = "".join(w + r.choice([" ", "  ", "\n"]) for w in words)
        out.append((10 + i, text))
        if i % 7 == 0:
            out.append((1000 + i, text))
    return out


def slow_overlaps(rows, size):
    owner = {}
    for page, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            owner.setdefault(b[i : i + size], page)
    out = []
    for page, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if owner[b[i : i + size]] < page:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((page, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def slow_passages(rows, window):
    texts = [(p, WORD.findall(t or "")) for p, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for page, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((page, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("size", [24, 50])
def test_overlaps(spark, size):
    rows = invented(60)
    got = [(r.page_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in overlaps.remove_overlaps(pages(spark, rows), size).collect()]
    assert sorted(got) == slow_overlaps(rows, size)


@pytest.mark.parametrize("window", [2, 14, 20, 35])
def test_passages(spark, window):
    rows = invented(60)
    got = [tuple(r) for r in passages.remove_repeated_passages(pages(spark, rows), window).collect()]
    assert sorted(got) == slow_passages(rows, window)


def test_chunks_of_one_text(spark, monkeypatch):
    """Every text in a chunk of its own: all matches go through the buckets."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1)
    rows = invented(30, 9)
    chunks = exchange.write_chunks(pages(spark, rows), "page_id", "text", "test")
    assert chunks.count() <= len(rows)
    got = [tuple(r) for r in passages.remove_repeated_passages(pages(spark, rows), 20).collect()]
    assert sorted(got) == slow_passages(rows, 20)


@pytest.mark.parametrize("chunk", [1, 4000])
def test_overlaps_with_hot_pieces(spark, monkeypatch, chunk):
    """Windows around frequent pieces are dealt out one by one; the result stays the same."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(overlaps, "HOT_STRINGS", 3)
    rows = invented(40, 11)
    got = [(r.page_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in overlaps.remove_overlaps(pages(spark, rows)).collect()]
    assert sorted(got) == slow_overlaps(rows, 50)


def test_cover_holds_all_differences():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_suffix_sort_orders_by_bytes():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)) + b"abc" * 200, np.uint8)
    start = np.arange(len(data) - 40)
    got = overlaps.Suffixes(data, start, 40)
    raw = data.tobytes()
    keys = [raw[i : i + 40] for i in got.at]
    assert keys == sorted(keys)
    assert [a == b for a, b in itertools.pairwise(keys)] == [a == b for a, b in itertools.pairwise(got.kind.tolist())]


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(overlaps, "span_hashes", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" * 3 + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)
    got = overlaps.Suffixes(data, np.arange(len(data) - 24), 24)
    raw = data.tobytes()
    keys = [raw[i : i + 24] for i in got.at]
    assert keys == sorted(keys) and len(set(keys)) == got.kind.max() + 1
    first, which = overlaps.distinct_spans(data, overlaps.eights(data), np.array([0, 36, 1, 108]), np.array([30, 30, 30, 30]))
    spans = [raw[i : i + 30] for i in (0, 36, 1, 108)]
    assert spans[0] == spans[1] and which[0] == which[1] and len({which[0], which[2], which[3]}) == 3


def test_null_page_loses_to_all(spark):
    text = "".join(chr(97 + i % 26) * (i % 5 + 1) for i in range(60))
    rows = overlaps.remove_overlaps(pages(spark, [(None, text), (7, text)]), 50).collect()
    assert {r.page_id: r.n_removed for r in rows} == {None: len(text), 7: 0}


@pytest.mark.parametrize("operator", [overlaps.remove_overlaps, passages.remove_repeated_passages, near.near_duplicates, rules.screen_texts])
def test_empty_table(spark, operator):
    assert operator(pages(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op6_substring_dedup"])
def test_dedup_query_on_documents(spark, name):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    if name.startswith("op2"):
        want = [(*r[:4], sha(r[4])) for r in slow_overlaps(docs, 50)]
    else:
        want = [(*r[:3], sha(r[3].encode())) for r in slow_passages(docs, 35)]
    assert got == sorted(want)


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(marked))


def test_rules(spark):
    rows = [*invented(60), (90, "one two three four five six seven eight nine " * 9), (91, " ".join(f"word{i}#" for i in range(30))), (92, "A\nA\nB\nB\nA c d e f g\n" * 3)]
    got = rules.screen_texts(pages(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert sorted((r.page_id, *(r[n] for n in names)) for r in got) == sorted((p, *slow_counts(t)) for p, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.failed_rule is None)
    assert any(r.failed_rule == "symbols" for r in got)


def test_rule_order_never_changes_a_verdict(spark):
    counted = rules.with_counts(pages(spark, invented(40)))
    own = rules.default_rules()
    assert {r.name for r in rules.order_rules(counted, own, 10)} == {r.name for r in own}
    a = rules.screen_texts(pages(spark, invented(40)), own).select("page_id", "kept").collect()
    b = rules.screen_texts(pages(spark, invented(40)), own[::-1], sample_pages=5).select("page_id", "kept").collect()
    assert sorted(a) == sorted(b)
    never = [rules.Rule("null", F.lit(None).cast("boolean"))]
    assert all(r.kept != r.base_failed for r in rules.screen_texts(pages(spark, invented(40)), never).collect())


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id]) for r in labels if rows[r.doc_id].held_out]
    assert len(rows) == 1000 and len(held) > 50
    good, bad = [x.score for q, x in held if q == 1], [x.score for q, x in held if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.98
    assert np.mean([x.predicted == q for q, x in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_edges(spark):
    rows = invented(20)
    none = spark.createDataFrame([], "page_id bigint, accepted int")
    assert {r.score for r in quality.grade_pages(pages(spark, rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(10, 1), (11, 1), (11, 1), (12, None), (None, 0), (13, 7)], "page_id bigint, accepted int")
    got = quality.grade_pages(pages(spark, rows), one).collect()
    assert len(got) == len(rows) and all(r.score is not None and np.isfinite(r.score) for r in got)
    assert quality.grade_pages(pages(spark, []), one).collect() == []


def test_logistic_curve_survives_outliers():
    """Classes that lie far apart, and some accepted pages among the rejected ones."""
    at = np.arange(-60, 60, 0.25) + 0.125
    good, bad = np.zeros(len(at)), np.zeros(len(at))
    good[at > 11], bad[0], good[0] = 70, 2234, 5
    slope, shift = quality.logistic_curve(at, good, bad)
    score = 1 / (1 + np.exp(-(slope * at + shift)))
    assert score[0] < 0.1 and score[at > 12].min() > 0.9
    flat = quality.logistic_curve(at, np.zeros(len(at)), np.zeros(len(at)))
    assert flat == pytest.approx((1.0, 0.0))


def test_statistics_do_not_hang_on_neighbours():
    texts = [t or "" for _, t in invented(20)]
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    every = quality.text_statistics(joined, offsets)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(every[i], quality.text_statistics(data, np.array([0, len(data)]))[0])


def shingles(text, size=5):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else collections.Counter()


def slow_classes(rows):
    bags = [(p, shingles(t)) for p, t in rows]
    root = list(range(len(bags)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(bags)), 2):
        a, b = bags[i][1], bags[j][1]
        common = sum((a & b).values())
        if common and 5 * common >= 4 * (sum(a.values()) + sum(b.values()) - common):
            root[find(j)] = find(i)
    least = {}
    for i, (p, _) in enumerate(bags):
        least[find(i)] = min(least.get(find(i), p), p)
    return sorted((p, least[find(i)]) for i, (p, _) in enumerate(bags))


def near_rows(seed=2):
    r = random.Random(seed)
    rows = invented(12)
    for group in range(4):
        base = [f"g{group}v{r.randint(0, 400)}" for _ in range(300)]
        for copy in range(9):
            words = list(base)
            for _ in range(copy if group else 1):
                words[r.randrange(300)] = f"c{r.randint(0, 9999)}"
            rows.append((2000 + 100 * group + copy, " ".join(words)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    got = sorted(tuple(r) for r in near.near_duplicates(pages(spark, rows)).collect())
    assert got == slow_classes(rows)


def test_near_chain_needs_all_rounds(spark):
    """Each text is similar to the next only: links must go through members that are far from the first."""
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 300])) for i in range(12)]
    got = sorted(tuple(r) for r in near.near_duplicates(pages(spark, rows)).collect())
    assert got == slow_classes(rows)


def test_signatures_estimate_the_weighted_similarity():
    r = random.Random(1)
    a = [(f"s{i}",) * 1 for i in range(200)]
    texts = [" ".join(w[0] for w in a), " ".join([*(w[0] for w in a[:150]), *(f"x{r.random()}" for _ in range(50))]), ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    sign = near.dart_signatures(*near.shingle_elements(arrays.Words(data, offsets), 5, 3), 3, 4000)
    bags = [shingles(t) for t in texts]
    common = sum((bags[0] & bags[1]).values())
    true = common / (sum(bags[0].values()) + sum(bags[1].values()) - common)
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04
    assert not sign[2].any()


def test_near_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op5_minhash_near_dedup"](spark, SF).collect()) == slow_classes(docs)


QUESTION = "A dealer sold 12 apples to Maria Lopez for 3 euros each and kept 40 kg of flour in the cellar until the following morning arrived."


def samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("n", F.lit(2))


def test_leaks(spark):
    filler = "quite other words stand here and go on for a while without any meaning at all. "
    changed = QUESTION.replace("12", "95").replace("Maria Lopez", "Peter Meyer").replace("40 kg", "7,5 kg").replace("3 euros", "8 euros")
    rows = [
        (1, filler + QUESTION + " " + filler),
        (2, filler + changed),
        (3, filler * 5),
        (4, None),
        (5, ""),
        (6, QUESTION.upper()[:40]),
        (7, (filler * 3000) + QUESTION.lower().replace("maria lopez", "Maria Lopez")),
        (1, filler + QUESTION + " " + filler),
        (None, QUESTION),
    ]
    items = samples(spark, [(70, QUESTION), (70, QUESTION), (71, "too short"), (72, None), (73, ""), (74, "rare quartz jumps softly")])
    got = {(r.page_id, r.sample_id): r for r in contamination.find_leaks(pages(spark, rows), items).collect()}
    assert set(got) == {(1, 70), (2, 70), (7, 70)}
    assert got[1, 70].exact and not got[2, 70].exact and got[2, 70].consistency == 1
    whole = contamination.find_leaks(pages(spark, [(1, "so a rare quartz, jumps softly!")]), items).collect()
    assert [(r.page_id, r.sample_id) for r in whole] == [(1, 74)]


def test_leaks_with_inconsistent_slots(spark):
    item = "take 5 stones and put 5 stones near the river where 5 stones rest beside 5 stones of another colour again"
    clash = "take 1 stones and put 2 stones near the river where 3 stones rest beside 4 stones of another colour again"
    fine = item.replace("5", "9")
    got = contamination.find_leaks(pages(spark, [(1, item), (2, clash), (3, fine)]), samples(spark, [(7, item)])).collect()
    assert {r.page_id for r in got} == {1, 3}


def test_leaks_empty(spark):
    assert contamination.find_leaks(pages(spark, []), samples(spark, [(1, QUESTION)])).collect() == []
    assert contamination.find_leaks(pages(spark, [(1, QUESTION)]), samples(spark, [])).collect() == []


def test_leaks_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if d.text and i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op3_benchmark_decontamination"](spark, SF).collect()} == want


def slow_leaks(docs, items):
    """Pairs whose page holds all words of the item in a row, in any case and with any punctuation between."""
    flat = lambda t: " " + " ".join(re.findall(r"[a-zß-ÿ]+|\d+(?:[.,]\d+)*", (t or "").lower())) + " "
    texts = {d: flat(t) for d, t in docs}
    return {(d, i) for i, t in items for d, text in texts.items() if flat(t) in text}


def test_leaks_in_any_case(spark):
    """Copies in capitals, in title case and without punctuation, of all items."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bare = lambda t: re.sub(r"[.,;:!?\n]+", " ", t)
    rows = [(10 * i + k, f(t)) for i, t in items for k, f in enumerate([str.upper, str.title, bare, str.lower])]
    got = {(r.page_id, r.sample_id) for r in contamination.find_leaks(pages(spark, rows), samples(spark, items)).collect()}
    assert got >= {(10 * i + k, i) for i, _ in items for k in range(4)}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = contamination.find_leaks(pages(spark, docs, False), samples(spark, items)).collect()
    assert {(r.page_id, r.sample_id) for r in found} >= slow_leaks(docs, items)
    german = "Die Straße ist groß und heißt nach außen hin Weiße Gasse"
    assert contamination.find_leaks(pages(spark, [(1, german.upper())]), samples(spark, [(1, german)])).count() == 1
    greek = "ΠΟΣΑ ΜΗΛΑ ΕΧΕΙ Η ΜΑΡΙΑ ΣΤΟ ΚΑΛΑΘΙ ΤΗΣ ΣΗΜΕΡΑ"
    assert contamination.find_leaks(pages(spark, [(1, greek.lower())]), samples(spark, [(1, greek)])).count() == 1


def test_leaks_of_any_words(spark):
    """Verbatim items of numbers, of names, of few words, and of scripts without spaces; typographic punctuation."""
    items = [
        (1, "Compute 12 + 7 * 3 - 48 / 6 + 5 - 2 + 9 * 4 - 1 and 3 + 3"),
        (2, "On Monday Alice met Bob, Carol, Dave and Erin in Paris, Rome, Oslo and Bern"),
        (3, "What is the capital of France?"),
        (4, "太郎は毎朝りんごを三つ買います。"),
        (5, 'the "old" clock - it was broken - stood in the hall of the house'),
        (6, "สวัสดีครับผมชื่อสมชาย"),
    ]
    rows = [(i, "they asked " + t + " and so on") for i, t in items]
    rows[4] = (5, "here the \u201cold\u201d clock\u2014it\u00a0was bro\u00adken\u2014stood in\u2003the hall of the house")
    rows.append((9, "nothing of the kind stands here, whatever 1 + 1 makes in the capital of another land"))
    got = {(r.page_id, r.sample_id) for r in contamination.find_leaks(pages(spark, rows), samples(spark, items)).collect()}
    assert got == {(i, i) for i, _ in items}


def test_leaks_with_other_subjects(spark):
    """Names that open sentences, and names of another number of words."""
    tom = "Tom buys 4 pens at the market. Tom gives 2 pens to Ann. Tom then buys 3 more pens. How many pens does Tom have?"
    bob = tom.replace("Tom", "Bob").replace("Ann", "Sue").replace("4", "7")
    weekly = "James writes letters to friends twice a week"
    long = tom.replace("Tom", "Mary Jane").replace("Ann", "Sue van Dyke")
    other = "Bob buys 7 books at the station and Sue reads them. Nobody knows how many books Bob has, but he then sells them all."
    rows = [(1, bob), (2, weekly.replace("James", "Peter")), (3, "they say " + long), (4, other), (5, weekly.replace("James", "Peter Paul"))]
    got = contamination.find_leaks(pages(spark, rows), samples(spark, [(1, tom), (2, weekly)])).collect()
    assert {(r.page_id, r.sample_id) for r in got} == {(1, 1), (2, 2), (3, 1), (5, 2)}


def test_leaks_of_parts(spark):
    """A run of 13 words of a long item is found, one of 12 isn't; so are runs with other figures, if they are consistent."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    figures = " ".join(w if i % 4 else str(i % 8) for i, w in enumerate(words))
    other = " ".join(w if i % 4 else str(i % 8 + 50) for i, w in enumerate(words))
    clash = " ".join(w if i % 4 else str(i + 50) for i, w in enumerate(words))
    part = lambda text, a, b: "here " + " ".join(text.split()[a:b]) + " there"
    rows = [(1, part(" ".join(words), 100, 113)), (2, part(" ".join(words), 100, 112)), (3, part(other, 200, 220)), (4, part(clash, 200, 220))]
    rows.append((5, part(figures, 200, 210) + part(figures, 10, 20)))
    got = contamination.find_leaks(pages(spark, rows), samples(spark, [(1, " ".join(words)), (2, figures)])).collect()
    assert {(r.page_id, r.sample_id) for r in got} == {(1, 1), (3, 2)}
    assert all(r.coverage < 0.5 for r in got)


def thue_morse(n, a, b):
    out = [a]
    other = [b]
    while len(out) < n:
        out, other = out + other, other + out
    return out


def test_words_built_to_collide(spark):
    """Strings that every polynomial modulo 2**64 takes for equal, as letters of one word and as words of one text."""
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    lead = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{lead} {one}"), (2, f"{lead} {two}"), (3, one), (4, two)]
    rows += [(5, " ".join(thue_morse(1024, "x", "y"))), (6, " ".join(thue_morse(1024, "y", "x")))]
    assert not any(r.n_removed for r in passages.remove_repeated_passages(pages(spark, rows[:4])).collect())
    got = sorted((r.page_id, r.n_words, r.n_removed, r.text) for r in passages.remove_repeated_passages(pages(spark, rows)).collect())
    assert got == slow_passages(rows, 35)
    cut = [(r.page_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in overlaps.remove_overlaps(pages(spark, rows)).collect()]
    assert sorted(cut) == slow_overlaps(rows, 50)
    classes = {r.page_id: r.class_id for r in near.near_duplicates(pages(spark, rows[2:4] + [(7, one)])).collect()}
    assert classes == {3: 3, 4: 4, 7: 3}
    samples = spark.createDataFrame([(1, f"{lead} {one}")], "sample_id bigint, text string")
    found = contamination.find_leaks(pages(spark, [(3, one), (4, two), (8, f"{lead} {one}")]), samples)
    assert {r.page_id for r in found.collect()} == {8}


def test_leaks_of_short_and_figured_items(spark):
    """Items of a few words verbatim, items of little but figures and names with others, number words as numbers."""
    samples = [(1, "Why not?"), (2, "Sea level"), (3, "Antarctica"), (5, "How many days are left if seven of nine pass?")]
    samples.append((4, "In 1905 Smith paid 40 dollars, 12 cents, 7 euros and 9 pounds to Jones."))
    texts = [(10, "He asked why, not how. WHY NOT? she said."), (11, "it lies at sea level here"), (12, "the seal evels"), (13, "to antarctica, and back")]
    texts += [(14, "They say: in 1872 Brown paid 55 dollars, 31 cents, 6 euros and 2 pounds to Miller. So it was."), (15, "In 1905 it rained for 40 days and 7 nights.")]
    texts += [(16, "so how many days are left if 4 of 31 pass? Tell me")]
    found = contamination.find_leaks(spark.createDataFrame(texts, "page_id bigint, text string"), spark.createDataFrame(samples, "sample_id bigint, text string"))
    assert sorted((r.page_id, r.sample_id) for r in found.collect()) == [(10, 1), (11, 2), (13, 3), (14, 4), (16, 5)]


def test_leaks_recall_on_other_figures_and_names(spark):
    """The items of the benchmark with figures, number words, names and units put in, against copies with others, are found, nine in ten."""
    words = [(r.item_id, r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    r = random.Random(12)
    kinds = [["7", "12", "1,905", "3.5"], ["two", "five", "nine"], ["Zora", "Quentin", "Ivo Maria"], ["4 km", "9 dollars", "30 minutes"]]
    items, copies = [], []
    for i, text in words:
        mine, theirs = [text[0]], [text[0]]
        for w in text[1:]:
            if r.random() < 0.25:
                a, b = r.sample(r.choice(kinds), 2)
                mine.append(a)
                theirs.append(b)
            mine.append(w)
            theirs.append(w)
        items.append((i, " ".join(mine)))
        copies.append((i, f"somebody wrote it down once. {' '.join(theirs)} and that was all there was to say about it"))
    changed = sum(t not in c for (_, t), (_, c) in zip(items, copies, strict=True))
    found = contamination.find_leaks(
        spark.createDataFrame(copies, "page_id bigint, text string"), spark.createDataFrame(items, "sample_id bigint, text string"), consistency=0.0
    )
    hit = {r.page_id for r in found.filter("page_id = sample_id").collect()}
    assert changed > 0.9 * len(items) and len(hit) >= 0.9 * len(items)


def test_suffixes_of_near_copies_take_sorts_of_numbers():
    """A bucket of near copies: before, its long common extensions took a comparison after the other (22 s)."""
    rng = np.random.default_rng(5)
    page = rng.integers(97, 123, 20_000).astype(np.uint8)
    data = np.concatenate([np.where(rng.random(len(page)) < 0.005, 65, page).astype(np.uint8) for _ in range(100)])
    start = np.arange(len(data) - 50)
    began = time.process_time()
    got = overlaps.Suffixes(data, start, 50)
    assert time.process_time() - began < 8
    some = got.at[:: len(got.at) // 500]
    words = [data[x : x + 50].tobytes() for x in some]
    assert words == sorted(words)
    kinds = got.kind[:: len(got.at) // 500]
    assert all((a == b) == (x == y) for a, b, x, y in zip(words, words[1:], kinds, kinds[1:], strict=False))
