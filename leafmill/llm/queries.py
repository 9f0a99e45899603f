"""Queries of the training-data problems on text, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import language, lookalike, markup, ocr, packing, splitting, tokenizer
from leafmill.operators import nested
from leafmill.session import cut_lineage
from leafmill.sources import table


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Read twice, for the looks of several spellings and for their rows: texts are rewritten once.
    return cut_lineage(lookalike.fingerprints(docs, lookalike.class_table(_text(docs))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.pairs(_prints(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that looks like a differently stored one, with its class."""
    return lookalike.classes(_prints(spark, folder))


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of the texts of documents, entries and translations, under classes of all three."""
    docs, entries, jobs = (table(spark, folder, t) for t in ("documents", "page_entries", "translations"))
    classes = lookalike.class_table(_text(docs), _text(entries), _text(jobs))
    rows = (
        docs.select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("rec_id"), "text")
        .unionByName(entries.select(F.lit("page_entries").alias("tab"), F.concat_ws("/", "doc_id", "page_index", "entry_idx").alias("rec_id"), "text"))
        .unionByName(jobs.select(F.lit("translations").alias("tab"), F.col("id").cast("string").alias("rec_id"), "text"))
    )
    return lookalike.normalise(rows, classes, ["tab", "rec_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return markup.found(docs, markup.fit_on(docs))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every document."""
    docs = table(spark, folder, "documents")
    return markup.cleaned(docs, markup.fit_on(docs), ["doc_id"])


def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every entry of every layout."""
    docs = table(spark, folder, "documents")
    entries = nested.flat_tables(nested.occurrences(docs))["entries"].where("text is not null")
    return markup.cleaned(entries, markup.fit_on(docs), ["doc_id", "page_index", "entry_idx"])


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    docs, jobs = table(spark, folder, "documents"), table(spark, folder, "translations")
    return language.assign(language.labelled_rows(docs, jobs), language.fit_on(docs))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.contradictions(_assigned(spark, folder))


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language, confidence and ambiguity of every document, translation and segment."""
    return _assigned(spark, folder).drop("label").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.found(None, ocr.learn(table(spark, folder, "documents")))


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every document, in paragraphs and without noise where it was scanned."""
    docs = table(spark, folder, "documents")
    return ocr.texts(docs, ocr.learn(docs))


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of every document's page entries."""
    docs, entries = table(spark, folder, "documents"), table(spark, folder, "page_entries")
    rows = ocr.entry_texts(entries).join(docs.select("doc_id", "scan_type"), "doc_id", "left")
    return ocr.texts(rows, ocr.learn(docs.select("text", "scan_type").unionByName(rows.select("text", "scan_type"))))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as decoded from its ids again."""
    return tokenizer.decode(tokenizer.encode(table(spark, folder, "documents")))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    limits = table(spark, folder, "model_limits").where("purpose = 'pack'")
    sizes = cut_lineage(tokenizer.encode(table(spark, folder, "documents"), ids=False))
    return packing.pack(sizes, limits, ["doc_id"]), limits


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, for each capacity; pieces from 1 where a text was divided."""
    return _packed(spark, folder)[0]


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.usage(*_packed(spark, folder))


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document above a limit, for each limit."""
    limits = table(spark, folder, "model_limits").where("purpose = 'split'")
    return splitting.split(table(spark, folder, "documents"), limits)


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_texts": p2_texts,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p3_entries": p3_entries,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p5_entries": p5_entries,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_packs": p8_packs,
    "p8_usage": p8_usage,
    "p9_pieces": p9_pieces,
}

SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
