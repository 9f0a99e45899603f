"""Readers and writers of stored objects: layouts, artifacts, checkpoints, page windows.

Objects lie under keys ``documents/<id>/…`` and ``translations/<id>/…`` below
a root folder or bucket; everything is read and written by Spark's own
sources, so that files of a folder become partitions and no bytes pass the
driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import cut_lineage

# Names of a document's stored objects.
OBJECT_NAMES = {"source": "source", "markdown": "output.md", "json": "layout.json", "docx": "output.docx"}
LAYOUT = "array<struct<page_index:int,page_width_pt:double,page_height_pt:double,zoom:double,entries:array<struct<category:string,text:string,bbox:array<int>,rotation:double,source:string,image_key:string>>>>"


def objects(spark: SparkSession, root: str, kind: str = "documents", name: str = "*") -> DataFrame:
    """id, name, size and content of stored objects."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(f"{root}/{kind}")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), "content")


def layouts(spark: SparkSession, root: str, kind: str = "documents") -> DataFrame:
    """id and pages of every stored layout; one that can't be read has null pages."""
    text = F.decode("content", "UTF-8")
    return objects(spark, root, kind, OBJECT_NAMES["json"]).select("id", F.when(F.ltrim(text).startswith("["), F.from_json(text, LAYOUT)).alias("pages"))


def layout_entries(read: DataFrame) -> DataFrame:
    """One row for each entry of ``layouts``."""
    pages = read.select("id", F.posexplode("pages").alias("pos", "p"))
    return pages.select("id", F.coalesce("p.page_index", "pos").alias("page_index"), "p.page_width_pt", "p.page_height_pt", "p.zoom", F.posexplode("p.entries").alias("entry_idx", "e")).select("id", "page_index", "page_width_pt", "page_height_pt", "zoom", "entry_idx", "e.*")


def resolved(rows: DataFrame, stored: DataFrame, kinds: Mapping[str, str], kind: str) -> DataFrame:
    """Rows with the object that their key of ``kind`` names: ``state`` is ok, no key, or missing."""
    key = F.col(kinds[kind])
    named = stored.select(F.col("id").alias("_id"), F.col("name").alias("_name"), "size")
    parts = F.split(key, "/")
    joined = rows.join(named, (F.get(parts, F.lit(1)) == F.col("_id")) & (F.element_at(parts, -1) == F.col("_name")), "left")
    return joined.withColumn("state", F.when(key.isNull(), "no key").when(F.col("_id").isNull(), "missing").otherwise("ok")).drop("_id", "_name")


def window_of(page_index: Column, size: int) -> Column:
    """The window of ``size`` pages that a page falls into."""
    return F.floor(page_index / size).cast("int")


def windows(documents: DataFrame, size: int = 32) -> DataFrame:
    """doc_id, first and end (half open) of every page window of documents with pages."""
    starts = F.sequence(F.lit(0), F.col("page_count") - 1, F.lit(size))
    return documents.where("page_count > 0").select("doc_id", "page_count", F.explode(starts).alias("first")).select("doc_id", "first", F.least(F.col("first") + size, F.col("page_count")).alias("end"))


def table_of(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database over JDBC, read in ``parts`` ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def store_layouts(pages: DataFrame, root: str) -> None:
    """``pages(id, pages)`` as one JSON folder for each id, which ``read_checkpoints`` reads; written again, a folder is replaced."""
    pages.select("id", F.to_json("pages").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").text(root)


def basename(key: Column) -> Column:
    """The last part of a key, so that no key leads out of its folder; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_extract(key, r"([^/\\]+)$", 1), r"^\.+$", ""), F.lit(""))


def image_key(kind: str, row_id: Column, key: Column) -> Column:
    """Where a picture of a document lies, whatever folders its name had."""
    return F.concat(F.lit(f"{kind}/"), row_id, F.lit("/images/"), basename(key))


# What the objects of each kind are.
CONTENT_TYPES = {"markdown": "text/markdown", "json": "application/json", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image": "image/png", "source": "application/octet-stream"}


def put_objects(contents: DataFrame, root: str, kind: str = "documents") -> DataFrame:
    """Writes ``contents(id, artifact, name, content)`` below ``root`` and gives id, artifact, key, content_type and size of each, once all are written.

    ``artifact`` is one of CONTENT_TYPES, others are refused; ``name`` counts
    for sources and images. Each task writes its own objects, under another
    name first, so that a task that is run again leaves whole objects only.
    """
    of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    fixed = F.try_element_at(of({k: v for k, v in OBJECT_NAMES.items() if k != "source"}), F.col("artifact"))
    name = F.when(F.col("artifact") == "image", F.concat(F.lit("images/"), basename(F.col("name")))).when(F.col("artifact") == "source", F.concat(F.lit("source"), F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"(\.[A-Za-z0-9]+)$", 1)))).otherwise(fixed)
    kind_of = F.try_element_at(of(CONTENT_TYPES), F.col("artifact"))
    known = F.when(kind_of.isNull() | name.isNull(), F.raise_error(F.concat(F.lit("no such artifact: "), F.coalesce("artifact", F.lit("null"))))).otherwise(name)
    rows = contents.select("id", "artifact", F.concat(F.lit(f"{kind}/"), F.col("id"), F.lit("/"), known).alias("key"), kind_of.alias("content_type"), "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            sizes = []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist()):
                path = f"{base}/{key}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, path)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "artifact", "key", "content_type")), pa.array(sizes, pa.int64())], names=["id", "artifact", "key", "content_type", "size"])

    return cut_lineage(rows.mapInArrow(write, "id string, artifact string, key string, content_type string, size long"))


def insert(rows: DataFrame, contents: DataFrame, root: str, table: str, at: Column, key_column: str = "source_key", kind: str = "documents") -> DataFrame:
    """Appends ``rows(id, …)`` as queued to the Parquet table ``table`` after their bytes are written, and gives the rows appended; rows without bytes stay out.

    If writing the bytes fails, no row is appended; objects without a row are
    what a later run overwrites.
    """
    stored = put_objects(contents, root, kind).where("artifact = 'source'").select("id", F.col("key").alias(key_column))
    new = rows.drop(key_column, "status", "created_at", "updated_at").join(stored, "id").withColumns({"status": F.lit("queued"), "created_at": at, "updated_at": at})
    new = cut_lineage(new)
    new.write.mode("append").parquet(table)
    return new


def read_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """id and pages of stored checkpoints; a missing folder gives none, a damaged one null pages."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"id string, pages {LAYOUT}")
    return spark.read.option("wholetext", "true").text(root).select(F.col("id").cast("string"), F.from_json("value", LAYOUT).alias("pages"))
