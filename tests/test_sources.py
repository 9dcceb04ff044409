"""Files in, files out."""

import json
import struct
import zlib

from scorelake.functions.lcs import register
from scorelake.operators import labels, problems, splits
from scorelake.operators.placement import resolve_parent
from scorelake.sources import documents as dc
from scorelake.sources import inputs as inp
from scorelake.sources import sinks
from scorelake.streaming import jobs


def png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def test_manifest(spark, tmp_path):
    entries = [{"id": f"E{i}", "subset": "a" if i % 2 else "b", "gt": None if i == 5 else f"gt/E{i}.json", "status": "pending" if i == 1 else "ready"} for i in range(8)]
    (tmp_path / "manifest.json").write_text(json.dumps({"entries": entries}))
    e = inp.manifest_entries(dc.read_documents(spark, str(tmp_path)))
    ids = lambda df: [r.id for r in df.orderBy("pos").collect()]
    assert ids(inp.select_entries(e, subset="a", limit=3)) == ["E3"]  # E1 pending, E5 without truth
    assert ids(inp.select_entries(e, subset="a", limit=3, order="accuracy")) == ["E3", "E7"]
    files = spark.createDataFrame([("gt/E3.json",)], "path string")
    assert [r.sample_id for r in inp.missing_files(inp.select_entries(e, subset="a"), files).collect()] == ["E7"]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(640, 800))
    (tmp_path / "b.png").write_bytes(png(640, 800))
    (tmp_path / "c.txt").write_bytes(b"no image")
    inv = inp.image_inventory(spark, str(tmp_path))
    assert sorted((r.width, r.height) for r in inv.collect() if r.width) == [(640, 800), (640, 800)]
    assert [r.copies for r in inp.duplicate_images(inv).collect()] == [2]
    url = spark.createDataFrame([("data:image/png;base64,aGk=",), ("http://x",)], "u string")
    got = inp.decode_data_urls(url, "u").collect()
    assert bytes(got[0].content) == b"hi" and got[0].format == "png" and got[1].content is None


def test_recognizer_errors_become_rows(spark):
    images = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "sample_id string, content binary")

    def recognize(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return {"score": "{}", "structure": None}

    got = {r.sample_id: r for r in inp.recognize_images(images, recognize).collect()}
    assert got["a"].score == "{}" and got["a"].error is None and "unreadable" in got["b"].error


def test_runs_and_trials(spark, tmp_path):
    (tmp_path / "r1.json").write_text('[{"epoch":1,"train_loss":2.0,"val":{"loss":NaN}},{"epoch":2,"train_loss":1.0,"val":{"loss":0.5}}]')
    h = inp.run_history(dc.read_documents(spark, str(tmp_path)))
    assert [r.val_loss for r in h.orderBy("epoch").collect()] == [None, 0.5]
    last = inp.last_epochs(h).first()
    assert (last.epochs, last.epoch, last.train_loss) == (2, 2, 1.0)
    log = tmp_path / "log"
    log.mkdir()
    (log / "l3.jsonl").write_text('{"trial":0,"params":{"w":24},"loss":0.5}\n{"trial":1,"params":{"w":16},"loss":0.25}\n')
    trials = inp.read_trials(spark, str(log))
    assert [(r.layer, r.trial, r.params["w"]) for r in trials.orderBy("trial").collect()] == [("l3", 0, 24.0), ("l3", 1, 16.0)]


def test_generated_pages_round_trip(spark, tmp_path):
    t = inp.synthetic_layouts(spark, 12, 3)
    assert all(3 <= r["count"] <= 6 for r in t["systems"].groupBy("page_id").count().collect())
    measures = splits.derive_measures(t["systems"], t["splits"])
    key = {"page_id": "sample_id"}
    names = {k: t[k].withColumnsRenamed(key) for k in t}
    regions = names["regions"].selectExpr("*", "CASE role WHEN 'title' THEN 0 ELSE 1 END AS region_idx")
    docs = sinks.layout_documents(names["pages"], regions, names["systems"], names["splits"], measures.withColumnsRenamed(key))
    back = dc.layout_tables(docs)
    assert back["splits"].count() == t["splits"].count() and back["measures"].count() == measures.count()
    rows = resolve_parent(back["rows"], back["systems"])
    bad = problems.validate_layouts(back["samples"], back["regions"], back["systems"], rows, back["splits"], back["measures"])
    assert bad.count() == 0
    ok = problems.verdict(back["samples"], bad)
    sinks.write_layouts(docs, ok, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    heat = labels.heat_arrays(labels.build_heat(t["splits"].selectExpr("page_id", "system_idx", "x / 10 AS center"), ["page_id", "system_idx"], 64, 1.5), ["page_id", "system_idx"])
    assert all(len(r.heat) == 64 for r in heat.collect())
    lines, again = labels.layout_from_boxes(t["systems"], t["splits"].select("page_id", "system_idx", "x"))
    assert lines.count() == t["splits"].count() and again.count() == measures.count()


def test_baselines_and_sql_function(spark, tmp_path):
    report = spark.createDataFrame([("L1", 0.5), ("L2", 0.75)], "layer string, mean_f1 double")
    path = str(tmp_path / "baselines")
    sinks.save_baseline(report, "one", path)
    sinks.save_baseline(report.where("layer = 'L1'"), "two", path)
    sinks.save_baseline(report, "one", path)
    assert sinks.load_baseline(spark, "one", path).count() == 2 and sinks.load_baseline(spark, "two", path).count() == 1
    register(spark)
    assert spark.sql("SELECT lcs_length(array('1','2','3'), array('1','9','3'))").first()[0] == 2


def test_edit_batches(spark, tmp_path):
    src = str(tmp_path / "edits")
    spark.range(5).selectExpr("id AS page_id").write.parquet(src)
    seen = []
    q = jobs.apply_edit_batches(spark.readStream.schema("page_id long").parquet(src), lambda df: seen.append(df.count()), f"t{tmp_path.name}")
    q.awaitTermination()
    assert sum(seen) == 5
