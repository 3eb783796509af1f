"""The run store, JSON lines exchange and the page stream."""

from __future__ import annotations

import json

import pytest

from quire import schemas
from quire.sources import ledger
from quire.streaming import pages

RUN = ("r1", 10, None, "in.png", "ocr", "int8", "v1", 0, "ok")


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.RUNS)


def test_store(spark, tmp_path):
    store = ledger.RunStore(spark, f"file://{tmp_path}/runs")
    assert not store.exists() and store.runs().count() == 0
    store.write(frame(spark, [RUN, ("r2", 20, 25, *RUN[3:]), ("r3", 20, None, *RUN[3:])]))
    store.write(frame(spark, [("r1", 30, 31, "new.png", *RUN[4:])]))
    assert [r.run_id for r in store.list(2).collect()] == ["r1", "r3"]
    assert [r.run_id for r in ledger.canonical(store.runs()).collect()] == ["r1", "r2", "r3"]
    assert store.run("r1").first().input_path == "new.png" and store.list(-1).count() == 0
    doc = json.loads(ledger.document(store.list(10), "runs", "s").first().document)
    assert doc["count"] == 3 and doc["runs"][0]["run_id"] == "r1"
    assert json.loads(ledger.document(store.runs().limit(0), "runs", "s").first().document)["count"] == 0
    spark.createDataFrame([(9, 99, "x")], "schema_version int, version long, folder string").write.mode("append").json(f"file://{tmp_path}/runs/_meta")
    with pytest.raises(ledger.FormatMismatch):
        store.runs()


def test_json_lines(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = frame(spark, [("b", *RUN[1:]), ("a", 1, 2, *RUN[3:])])
    assert ledger.export_jsonl(rows, out) == 2
    lines = [r.value for r in spark.read.text(out).collect()]
    assert [list(json.loads(x)) for x in lines] == [sorted(json.loads(x)) for x in lines]
    back = ledger.import_jsonl(spark, out).select(*[f.name for f in schemas.RUNS])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    good = json.dumps(dict(zip([f.name for f in schemas.RUNS], RUN, strict=True)))
    (tmp_path / "bad.jsonl").write_text(f"{good}\n\n  \n{{broken\n{good}\n")
    with pytest.raises(ledger.MalformedLine, match="line 4 "):
        ledger.import_jsonl(spark, f"file://{tmp_path}/bad.jsonl")
    (tmp_path / "lost.jsonl").write_text(good.replace('"mode"', '"other"'))
    with pytest.raises(ledger.MalformedLine, match="line 1 "):
        ledger.import_jsonl(spark, f"file://{tmp_path}/lost.jsonl")


def test_upsert_last_wins(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, None, 1), (2, "c", 0), (3, "d", 0)], "k int, v string, seq int")
    got = {r.k: r.v for r in ledger.upsert(base, new, ["k"], "seq").collect()}
    assert got == {1: "a", 2: None, 3: "d"}


def test_page_stream_equals_batch(spark, tmp_path):
    texts = {"x": "lead<PAGE> one <PAGE>two\n<PAGE>", "y": "none", "z": "<PA" + "GE>only"}
    chunks = []
    for key, t in texts.items():
        parts = [t[i : i + 5] for i in range(0, len(t), 5)]
        chunks += [(key, i, p, False) for i, p in enumerate(parts)] + [(key, len(parts), "", True)]
    schema = "key string, seq long, text string, last boolean"
    folder = tmp_path / "in"
    for n, part in enumerate((chunks[:6], chunks[4:])):  # the second file feeds two chunks again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{folder}")
        assert n < 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")
    query = pages.scan_stream(stream).writeStream.format("memory").queryName("scanned").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted(map(tuple, spark.table("scanned").collect()))
    batch = pages.split_pages(spark.createDataFrame(list(texts.items()), "key string, text string"), "key", "text")
    assert got == sorted(map(tuple, batch.collect()))
