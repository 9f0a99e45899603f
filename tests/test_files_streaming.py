import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafmill.operators import incremental
from leafmill.sources import files, table
from leafmill.streaming import arrivals


def test_stored_objects(spark, tmp_path):
    root = tmp_path / "store"
    for name, body in (("a", json.dumps([{"page_index": 3, "entries": [{"category": "Text", "bbox": [1, 2, 3, 4]}]}])), ("b", "not a list"), ("c", "[1,")):
        os.makedirs(root / "documents" / name)
        (root / "documents" / name / "layout.json").write_text(body)
    read = files.layouts(spark, str(root))
    assert read.count() == 3 and read.where("pages is not null and id = 'a'").count() == 1
    assert [tuple(r) for r in files.layout_entries(read).select("id", "page_index", "entry_idx").where("id = 'a'").collect()] == [("a", 3, 0)]
    rows = spark.createDataFrame([(1, "documents/a/layout.json"), (2, None), (3, "documents/z/layout.json")], "doc_id int, json_key string")
    got = files.resolved(rows, files.objects(spark, str(root)), {"json": "json_key"}, "json")
    assert {r.doc_id: r.state for r in got.collect()} == {1: "ok", 2: "no key", 3: "missing"}


def test_checkpoints(spark, tmp_path):
    root = str(tmp_path / "checkpoints")
    assert files.read_checkpoints(spark, root).count() == 0
    pages = spark.createDataFrame([("x", [(0, 1.0, 1.0, 1.0, [("Text", "t", [1, 2, 3, 4], None, None, None)])])], f"id string, pages {files.LAYOUT}")
    for _ in range(2):
        files.store_layouts(pages, root)
    back = files.read_checkpoints(spark, root).collect()
    assert len(back) == 1 and back[0].pages[0].entries[0].text == "t"


def test_windows_tile_the_pages(spark):
    for total in (0, 1, 5, 32, 33, 100):
        for size in (1, 3, 32):
            df = spark.createDataFrame([(1, total), (2, None)], "doc_id long, page_count int")
            spans = sorted((r.first, r.end) for r in files.windows(df, size).collect())
            assert [p for a, b in spans for p in range(a, b)] == list(range(total))


def test_stream_equals_batch(spark, folder, tmp_path):
    feed = table(spark, folder, "change_feed").orderBy("arrived_at", "feed_id").select("feed_id", "tab", "rec_id", "status", "updated_at", "arrived_at")
    rows = feed.toPandas()
    os.makedirs(tmp_path / "in")
    for k in range(3):
        part = rows.iloc[len(rows) * k // 3 : len(rows) * (k + 1) // 3]
        path = tmp_path / "in" / f"{k}.parquet"
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False), path, coerce_timestamps="us")
        os.utime(path, (k, k))
    stream = arrivals.feed_stream(spark, str(tmp_path / "in"), 1)
    query = arrivals.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {(r.tab, r.rec_id, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.tab, r.rec_id, r.version) for r in incremental.changes(feed).collect()}
    counted = arrivals.progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.sql("select sum(n) from progress").first()[0] == len(rows)


def test_a_change_back_within_a_batch_is_kept(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    row = lambda k, status, hours: {"feed_id": k, "tab": "d", "rec_id": "r", "status": status, "updated_at": t, "arrived_at": t + dt.timedelta(hours=hours)}
    files = [[row(1, "A", 1)], [row(2, "B", 2), row(3, "A", 3), row(3, "A", 3)], [row(4, "A", 4), row(5, None, 5), {**row(6, "C", 6), "updated_at": None}]]
    os.makedirs(tmp_path / "in")
    schema = pa.schema([("feed_id", pa.int64()), ("tab", pa.string()), ("rec_id", pa.string()), ("status", pa.string()), ("updated_at", pa.timestamp("us")), ("arrived_at", pa.timestamp("us"))])
    for k, rows in enumerate(files):
        path = tmp_path / "in" / f"{k}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, schema), path)
        os.utime(path, (k, k))
    stream = arrivals.feed_stream(spark, str(tmp_path / "in"), 1)
    arrivals.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r.version for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = spark.read.parquet(str(tmp_path / "in"))
    assert got == sorted(r.version for r in incremental.changes(every).collect()) == [1, 2, 3, 5]


def test_bytes_are_written_before_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "x.PDF", "error"), ("b", "y.pdf", None)], "id string, original_name string, status string")
    contents = spark.createDataFrame([("a", "source", "x.PDF", b"one"), ("a", "image", "../../etc\\\\p.png", b"two"), ("a", "json", None, b"[]"), ("a", "markdown", "", None)], "id string, artifact string, name string, content binary")
    new = files.insert(rows, contents, str(tmp_path / "store"), str(tmp_path / "documents.parquet"), F.lit("2025-01-01").cast("timestamp_ntz"))
    assert [(r.id, r.status, r.source_key) for r in new.collect()] == [("a", "queued", "documents/a/source.pdf")]
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() == 1
    assert sorted(str(p.relative_to(tmp_path / "store")) for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["documents/a/images/p.png", "documents/a/layout.json", "documents/a/output.md", "documents/a/source.pdf"]
    assert files.layouts(spark, str(tmp_path / "store")).count() == 1
    with pytest.raises(Exception, match="no such artifact"):
        files.insert(rows, contents.withColumn("artifact", F.lit("other")), str(tmp_path / "s2"), str(tmp_path / "d2.parquet"), F.lit("2025-01-01").cast("timestamp_ntz"))
    assert not os.path.exists(tmp_path / "d2.parquet")


def test_keys_of_images_stay_in_their_folder(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.png",), ("../../x/b.png",), ("c\\\\d.png",), ("..",), ("x/",), (None,)], "k string")
    assert [r[0] for r in df.select(files.basename(F.col("k"))).collect()] == ["a.png", "b.png", "d.png", None, None, None]
