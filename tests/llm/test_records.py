"""Links, archives, packing, tool calls and the pipeline."""

import base64
import fnmatch
import hashlib
import json
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import archives, chat, links, packing
from scorelake.llm.exchange import scratch
from scorelake.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    bad, rows, _, _ = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert not bad, "\n".join(bad)
    assert rows > 0


def fits(rule, host, path):
    rule_host, _, rule_path = rule.partition("/")
    hosts = fnmatch.fnmatchcase("." + host, "*." + rule_host.lower())
    return hosts and fnmatch.fnmatchcase(path, "/" + rule_path + "*")


def test_links(spark):
    rules = [("allow", "org/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "a?c.*/x*y"), ("block", "b.org/")]
    patterns = [("block", "*track*/"), ("block", "*/*login")]
    r = random.Random(4)
    hosts = ["example.org", "A.Example.ORG", "org", "norg", "x.com", "com", "abc.net", "tracker.de", "b.org", "abc.org", "é.com", ""]
    paths = ["", "/", "/en/1", "/en/12?x=/fr/", "/fr/", "/x/zy#q", "/login", "?a=://b.org/", "#", "/xy" * 90, "/é/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "nothing", "a/b", "x\x00://b\x00.org/\x00"]
    urls += ["http://" + "".join(r.choice("abc.orgxy/") for _ in range(20)) for _ in range(200)] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    for row in links.screen_links(df, rules, patterns).collect():
        url = urls[row.page_id] or ""
        _, found, rest = url.partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end]) if found else ""
        path = rest[end : min([i for i in (rest.find(c, end) for c in "?#") if i >= 0] or [len(rest)])] if found else ""
        assert (row.host, row.path) == (host, path)
        if "\x00" in url:
            continue
        hits = sorted((t for _, t in rules if fits(t, host, path)), key=lambda t: (len(t), t.index("/")))
        weak = sorted((t for _, t in patterns if fits(t, host, path)), key=lambda t: (len(t), t.index("/")))
        assert row.rule == (hits[-1] if hits else None)
        assert row.pattern == (None if hits or not weak else weak[-1])
        assert row.verdict == (dict((t, v) for v, t in rules + patterns)[row.rule or row.pattern] if hits or weak else "allow")


def test_links_edges(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert links.screen_links(empty, [("block", "a/")]).collect() == []
    one = spark.createDataFrame([(1, "http://a/")], "page_id bigint, url string")
    assert links.screen_links(one, []).first().verdict == "allow"
    with pytest.raises(ValueError):
        links.RuleAutomaton(["no-path"])


def files(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, body string").withColumn("owner", F.lit(1)).withColumn("digest", F.lit("d"))


def test_archives(spark):
    r = random.Random(8)
    body = lambda: "".join(r.choice("<p>abcdefé \n") for _ in range(r.randint(1, 900)))
    rows = [(i, f"http://x/{i}", body()) for i in range(120)]
    rows += [(200, None, None), (201, "http://a b\r\nX: y", ""), (202, "u", rows[5][2]), (203, "u", rows[5][2]), (204, "u", "z" * 3_000_000)]
    folder = scratch(spark, "test-archives")
    archives.archive_pages(files(spark, rows).repartition(4), folder)
    got = {int(x.page_id): x for x in archives.read_archives(spark, folder).collect()}
    assert len(got) == len(rows)
    for page, _, text in rows:
        data = (text or "").encode()
        same = [p for p, _, t in rows if (t or "") == (text or "")]
        x = got[page]
        assert x.payload_bytes == len(data) and x.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert x.refers_to == (None if page == max(same) else str(max(same)))
        assert (x.record_type, x.payload) == (("response", data) if page == max(same) else ("revisit", None))
    assert "\n" not in got[201].url


def test_archive_limits(spark):
    folder = scratch(spark, "test-archives")
    archives.archive_pages(files(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), folder, revisit_bytes=3)
    assert {x.page_id: x.refers_to for x in archives.read_archives(spark, folder, payloads=False).collect()} == {"1": None, "2": None, "3": "4", "4": None}
    folder = scratch(spark, "test-archives")
    archives.archive_pages(files(spark, []), folder)
    assert archives.read_archives(spark, folder).collect() == []


def test_damaged_archives():
    records = [archives.record(i, "http://x/", (f"<p>text {i} of a page</p>" * 40).encode()) for i in range(300)]
    whole = archives.write_archive(records)
    magic, size = struct.unpack_from("<II", whole)
    assert magic == archives.DICTIONARY_MAGIC
    assert list(archives.read_archive(whole + archives.EMPTY_FRAME)) == records
    squeezed = zstandard.ZstdCompressor().compress(whole[8 : 8 + size])  # a compressed dictionary is allowed
    again = struct.pack("<II", magic, len(squeezed)) + squeezed + whole[8 + size :]
    assert list(archives.read_archive(again)) == records
    for bad in (whole[:-3], whole + b"xx", whole + b"x" * 9, whole[: 8 + size // 2]):
        with pytest.raises((archives.ArchiveError, zstandard.ZstdError)):
            list(archives.read_archive(bad))
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"text 0", b"text 1"), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(archives.ArchiveError):
            archives.parse_record(bad)
    few = archives.write_archive(records[:1])
    assert list(archives.read_archive(few)) == records[:1]


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, r.choice([1, 7, 60, 300, 511, 512, 900, 4000, 9000])) for i in range(500)] + [(900, 0), (901, None), (902, -4), (3, 60)]
    df = spark.createDataFrame(rows, "score_id bigint, n_tokens bigint").withColumn("bin_id", F.lit("x")).withColumn("shard", F.lit(1))
    capacities = (512, 1024, 4096)
    got = packing.pack_sequences(df, capacities, shard_rows=100).collect()
    want = sum(max(n or 0, 0) + 1 for _, n in rows)
    assert sum(x.n_tokens for x in got) == want
    assert {x.score_id for x in got} == {s for s, _ in rows}
    bins = {}
    for x in got:
        bins.setdefault(x.bin_id, []).append(x)
    assert len({b >> 32 for b in bins}) > 3
    for content in bins.values():
        content.sort(key=lambda x: x.place)
        assert [x.place for x in content] == np.cumsum([0, *(x.n_tokens for x in content)]).tolist()[:-1]
        used = sum(x.n_tokens for x in content)
        assert all(x.used == used and x.capacity == min(c for c in capacities if c >= used) for x in content)
    nine = sorted((x.first_token, x.n_tokens) for x in got if x.score_id == next(s for s, n in rows if n == 9000))
    assert nine == [(0, 4096), (4096, 4096), (8192, 809)]
    room = sum(content[0].capacity for content in bins.values())
    assert want / room > 0.9
    assert packing.pack_sequences(df.filter("false")).collect() == []
    assert {x.score_id for x in packing.pack_sequences(df, separator=0).collect()} == {s for s, n in rows if n and n > 0}
    with pytest.raises(ValueError):
        packing.pack_sequences(df, ())


def test_best_fit_takes_the_tightest_bin():
    bins, capacity = packing.best_fit(np.array([60, 50, 40, 35, 15]), (100,), 0)
    assert bins.tolist() == [0, 1, 0, 1, 1] and capacity.tolist() == [100, 100]
    bins, capacity = packing.best_fit(np.array([40]), (64, 256), 4)
    assert capacity.tolist() == [64]


SCHEMAS = {"play": {"properties": {"page": "integer", "speed": "number", "parts": "array"}, "required": ["page"], "additional": False}, "stop": {}}


def test_tool_calls(spark):
    columns = "conv_id bigint, turn int, kind string, call_id string, name string, content string, after_id string"
    rows = [
        (1, 1, "call", "a", "play", '{"speed": 1.50, "page": 3, "parts": [1, {"z": 1, "b": "é\\n"}]}', "b"),
        (1, 2, "call", "b", "stop", "{}", "c"),
        (1, 3, "call", "c", "stop", "{}", None),
        (1, 4, "result", "a", None, 'done "now"', None),
        (1, 5, "result", "zz", None, None, None),
        (2, 1, "call", "a", "play", '{"page": "3", "x": 1}', "gone"),
        (2, 2, "call", "b", "fly", "{}", "d"),
        (2, 3, "call", "d", "play", "not json", "b"),
        (2, 4, "call", "e", "play", "[1]", "d"),
        (2, 5, "call", None, "stop", None, None),
        (2, 6, "call", "a", "stop", "{}", None),
        (3, 1, "result", None, None, "", None),
        (3, 2, "noise", "q", None, None, None),
        (None, 1, "call", "a", "stop", "{}", None),
    ] + [(4, i, "call", f"n{i}", "stop", "{}", f"n{i - 1}") for i in range(40)]
    df = spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in ("id", "depth", "up", "status", "result")})
    got = {(x.conv_id, x.call_id): x for x in chat.link_tool_calls(df, SCHEMAS).collect()}
    assert len(got) == 4 + 5 + 1 + 40
    assert [got[1, c].depth for c in "abc"] == [2, 1, 0]
    assert (got[1, "a"].status, got[1, "b"].status, got[1, "zz"].status) == ("linked", "open", "orphan")
    assert got[1, "a"].errors == [] and got[1, "zz"].errors == ["call: missing"]
    assert got[1, "a"].json == (
        '{"arguments":{"page":3,"parts":[1,{"b":"é\\n","z":1}],"speed":1.5},"id":"a","name":"play","result":"done \\"now\\""}'
    )
    assert got[2, "a"].errors == ["page: not integer", "x: unknown"] and got[2, "a"].depth == 0 and got[2, "a"].n_calls == 2
    assert got[2, "b"].errors == ["name: no such tool"] and got[2, "b"].depth is None and got[2, "e"].depth is None
    assert got[2, "d"].errors == ["arguments: not JSON"] and json.loads(got[2, "d"].json)["arguments"] == "not json"
    assert got[2, "e"].errors == ["arguments: not an object"]
    assert got[2, "#5"].errors == ["arguments: not JSON"] and got[3, "#1"].status == "orphan"
    assert [got[4, f"n{i}"].depth for i in range(40)] == list(range(40))
    assert chat.link_tool_calls(df.filter("false"), SCHEMAS).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = {r.doc_id: r for r in docs.collect()}
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = scratch(spark, f"test-{name}")
        stage(spark, at, SF).write.parquet(folder)
        at = spark.read.parquet(folder)
        assert at.columns == docs.columns
        seen.append({r.doc_id: r for r in at.collect()})
    graded = {r.doc_id for r in QUERIES["op1_quality_classifier"](spark, SF).filter("predicted = 1").collect()}
    assert set(seen[0]) == graded
    assert set(seen[1]) <= set(seen[0]) and len(seen[1]) < len(seen[0])
    assert all(seen[1][d] == read[d] for d in seen[1])
    for d, r in seen[2].items():
        assert r.n_chars == len(r.text) and (r.text == read[d].text or len(r.text) < len(read[d].text))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(seen[2]) - set(seen[3]) >= {d for d, r in seen[2].items() if any(i in r.text for i in items)}
    placed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in placed} == set(seen[3])
    assert sum(r.n_tokens for r in placed) == sum(len((r.text or "").split()) + 1 for r in seen[3].values())


def test_pipeline_odd_rows(spark):
    docs = spark.createDataFrame(
        [(900, None, "en", "s", 0), (901, "", None, None, None), (902, "word " * 3000, "en", "s", 15000), (903, "x", "en", "s", 1), (903, "x", "en", "s", 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for name, stage in corpus_pipeline.STAGES[1:]:
        folder = scratch(spark, f"test-odd-{name}")
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert {r.doc_id for r in docs.select("doc_id").collect()} >= {900, 901, 903}


def test_pipeline_repeated_ids(spark):
    """A row listed twice stays once and whole; two texts under one id keep their own text; a null id is an id like others."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(50))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("c") + " " + text("p")), (None, text("d")), (None, text("e") + " " + text("p"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeated_passages, corpus_pipeline.drop_leaks):
        folder = scratch(spark, "test-ids")
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
    want = [(1, text("a")), (2, text("b")), (2, text("c")), (None, text("d")), (None, text("e"))]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    good = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = corpus_pipeline.drop_low_quality(spark, good, SF)
    nulled = good.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    nulled = good.unionByName(nulled.filter("doc_id is null"))
    texts = accepted.filter("doc_id % 5 = 0").select("text").collect()
    got = corpus_pipeline.drop_low_quality(spark, nulled, SF).filter("doc_id is null").select("text").collect()
    assert sorted(map(str, got)) == sorted(map(str, texts)) and texts


def test_tool_call_ids_and_numbers(spark):
    columns = "conv_id bigint, turn int, kind string, call_id string, name string, content string, after_id string"
    numbers = ["1e2", "100.0", "100", "1.0E+2", "0.10", "1e-1", "-0.0", "0", "1e30", "10e29", "12345678901234567890123", "1e-20", "0.1e-19"]
    rows = [(1, i, "call", f"n{i}", "stop", f'{{"b": [{x}, "1e2 \\" 1.0"], "a": {x}}}', None) for i, x in enumerate(numbers)]
    rows += [(2, 5, "call", "#5", "stop", "{}", None), (2, 5, "result", None, None, "no id", None), (2, 6, "call", None, "stop", "{}", None)]
    rows += [(2, 6, "result", None, None, "not its result", None), (2, None, "call", None, "stop", "{}", None), (2, None, "result", None, None, "", None)]
    out = chat.link_tool_calls(spark.createDataFrame(rows, columns), SCHEMAS).collect()
    shown = {x.call_id: json.loads(x.json, parse_float=str, parse_int=str)["arguments"] for x in out if x.conv_id == 1}
    value = [shown[f"n{i}"]["a"] for i in range(len(numbers))]
    assert all(shown[f"n{i}"] == {"a": v, "b": [v, '1e2 " 1.0']} for i, v in enumerate(value))
    assert len(set(value[:4])) == len(set(value[4:6])) == len(set(value[6:8])) == len(set(value[8:10])) == len(set(value[11:13])) == 1
    assert value[0] == "100" and value[4] == "0.1" and value[6] == "0" and value[10] == numbers[10] and float(value[11]) == 1e-20
    two = sorted((x.call_id, x.status, x.position) for x in out if x.conv_id == 2)
    assert [x[:2] for x in two] == [("#", "open"), ("#", "orphan"), ("#5", "open"), ("#5", "orphan"), ("#6", "open"), ("#6", "orphan")]
    assert sorted(x[2] for x in two) == [1, 2, 3, 4, 5, 6] and {x for x in two if x[2] < 4} == {("#5", "open", 1), ("#6", "open", 2), ("#", "open", 3)}


def test_archive_ids_of_any_text(spark):
    ids = ["x>\r\nWARC-Type: x", "%41", "a b", "é日 ", "", "<>", None, "None", "5"]
    rows = [(p, "u", f"body {i}") for i, p in enumerate(ids)] + [("other\n", "u", "body 0"), (None, "u", "body 1")]
    df = spark.createDataFrame(rows, "page_id string, url string, body string")
    folder = scratch(spark, "test-archives")
    archives.archive_pages(df, folder)
    got = sorted((x.page_id, x.record_type, x.refers_to) for x in archives.read_archives(spark, folder).collect() if x.page_id is not None)
    largest = max("other\n", ids[0])
    assert [x[0] for x in got] == sorted([p for p in ids if p is not None] + ["other\n"])
    assert {x for x in got if x[1] == "revisit"} == {(min("other\n", ids[0]), "revisit", largest)}
    rest = [x for x in archives.read_archives(spark, folder).collect() if x.page_id is None]
    assert sorted((x.record_type, x.refers_to) for x in rest) == [("response", None), ("revisit", "%41")]


def test_packing_spreads_one_score(spark):
    rows = [(None, 7)] * 3000 + [(i, 7) for i in range(500)] + [(3, 9000)] * 40
    df = spark.createDataFrame(rows, "score_id bigint, n_tokens bigint")
    got = packing.pack_sequences(df, (512, 1024), shard_rows=100).collect()
    assert sum(x.n_tokens for x in got) == sum(n + 1 for _, n in rows) and sum(x.score_id is None for x in got) == 3000
    shards = np.unique([x.bin_id >> 32 for x in got], return_counts=True)[1]
    assert shards.max() < 200
