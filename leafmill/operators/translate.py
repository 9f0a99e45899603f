"""Translation of entries by units: take apart, chunk, call a model, check, try again, put back, resume.

A unit is a piece of an entry's text, keyed (doc_id, page_index, entry_idx,
part_idx); the key is what it is put back by. The model is a function from a
list of strings to a list of strings, called for chunks of whole units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.session import cut_lineage

ENTRY = ["doc_id", "page_index", "entry_idx"]
UNIT = [*ENTRY, "part_idx"]
Model = Callable[[list[str]], list[str]]


def upper_model(texts: list[str]) -> list[str]:
    """A stand-in for a model: upper case."""
    return [t.upper() for t in texts]


# Categories by how their text is taken apart.
TABLES, FORMULAS, SILENT = ("Table",), ("Equation-Block", "Formula"), ("Picture",)


def units(entries: DataFrame, formulas: bool = True) -> DataFrame:
    r"""Every part of every entry with text; ``wanted`` marks those that a model gets.

    Tables are cut at their tags, formulas at their \\text{} groups (none of
    which is wanted without ``formulas``), all other texts stay whole. ``unit``
    is what the model would get: of a group its inside, so ``wrapped`` says
    that it is put back as a group.
    """
    is_in = lambda names: F.coalesce(F.col("category").isin(*names), F.lit(False))
    cut = F.when(is_in(TABLES), X.parts(F.col("text"))).when(is_in(FORMULAS), X.formula_words(F.col("text"))).otherwise(F.array("text"))
    rows = entries.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        *ENTRY, is_in(SILENT).alias("silent"), is_in(TABLES).alias("table"), is_in(FORMULAS).alias("formula"), F.posexplode(cut).alias("part_idx", "part")
    )
    group = F.regexp_extract("part", r"^\\text\{([^{}]*)\}$", 1)
    wrapped = F.col("formula") & F.col("part").rlike(r"^\\text\{[^{}]*\}$")
    unit = F.when(wrapped, group).otherwise(F.col("part"))
    mine = ~F.col("silent") & ~(F.col("table") & F.col("part").startswith("<") & F.col("part").endswith(">")) & (~F.col("formula") | (wrapped & F.lit(formulas)))
    return rows.select(*UNIT, unit.alias("unit"), (mine & X.worth_translating(unit)).alias("wanted"), wrapped.alias("wrapped"))


def chunked(wanted: DataFrame, most_items: int = 20, most_bytes: int = 4000, window: int | None = None) -> DataFrame:
    """Units with the number of their chunk in the document: a chunk closes when it is full, or when the next unit would make it too large; one unit alone may be larger.

    A document's keys and sizes are numbered in one pass in key order; texts
    aren't collected. With ``window`` the groups are windows of so many pages,
    so that a document of any length is no single group; a chunk then also
    closes at a window's end, and chunk numbers begin anew in each.
    """
    group = ["doc_id"] if window is None else ["doc_id", "window_no"]
    sizes = wanted.select(*UNIT, X.utf8_size(F.col("unit")).cast("long").alias("bytes"), *([] if window is None else [F.floor(F.col("page_index") / window).cast("int").alias("window_no")]))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in UNIT[1:]])
        chunks, chunk, items, total = [], 0, 0, 0
        for size in table.column("bytes").to_pylist():
            if items and (items >= most_items or total + size > most_bytes):
                chunk, items, total = chunk + 1, 0, 0
            items, total = items + 1, total + size
            chunks.append(chunk)
        return table.select([*UNIT, *group[1:]]).append_column("chunk", pa.array(chunks, pa.int32()))

    schema = T.StructType([sizes.schema[c] for c in (*UNIT, *group[1:])] + [T.StructField("chunk", T.IntegerType())])
    return wanted.join(sizes.groupBy(*group).applyInArrow(number, schema), UNIT)


#: What parts the items of a chunk in a prompt; an answer that holds it is no translation.
SEPARATOR = "<<<ENTRY>>>"


def _ask(model: Model, texts: list[str]) -> list[str] | None:
    try:
        out = model(texts)
    except Exception:  # noqa: BLE001 — one call's failure must not end the task
        return None
    good = isinstance(out, list) and len(out) == len(texts) and all(isinstance(x, str) for x in out)
    return out if good and not any(SEPARATOR in x for x in out) else None


def called(chunks: DataFrame, model: Model, tries: int = 2) -> DataFrame:
    """Units with the model's ``result`` and whether it ``fell_back`` to the source.

    Boxes go to the model as words and come back as boxes. An answer of another
    length, an error, or an answer that echoes the separator is asked for once
    more, then item by item. A chunk's units make one row, a call each; the
    result is written once, so that no later step asks the model again.
    """
    group = [c for c in ("doc_id", "window_no", "chunk") if c in chunks.columns]
    unit = F.struct(*UNIT[1:], "unit", "wrapped")
    rows = chunks.groupBy(*group).agg(F.array_sort(F.collect_list(unit)).alias("us"))
    lists = rows.select(F.struct(*group, "us").alias("key"), F.transform("us", lambda u: X.masked(u["unit"])).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers: list[list[str]] = []
            fell: list[list[bool]] = []
            for texts in batch.column(1).to_pylist():
                whole = next((a for _ in range(tries) if (a := _ask(model, texts)) is not None), None)
                own = whole if whole is not None else [(_ask(model, [t]) or [None])[0] for t in texts]
                answers.append([t if o is None else o for t, o in zip(texts, own)])
                fell.append([o is None for o in own])
            yield pa.record_batch([batch.column(0), pa.array(answers, pa.list_(pa.string())), pa.array(fell, pa.list_(pa.bool_()))], names=["key", "results", "fell"])

    out = lists.mapInArrow(run, T.StructType([lists.schema["key"], T.StructField("results", T.ArrayType(T.StringType())), T.StructField("fell", T.ArrayType(T.BooleanType()))]))
    zipped = out.select("key.doc_id", "key.chunk", F.explode(F.arrays_zip(F.col("key.us").alias("us"), "results", "fell")).alias("z"))
    return cut_lineage(zipped.select("doc_id", *(F.col("z.us")[c].alias(c) for c in (*UNIT[1:], "unit", "wrapped")), "chunk", X.unmasked(F.col("z.results")).alias("result"), F.col("z.fell").alias("fell_back")))


def retried(results: DataFrame, model: Model, rounds: int = 2, batch: int = 10) -> DataFrame:
    """Results whose source and result both hold Chinese, Japanese or Korean are asked for again; an answer counts only if it holds none.

    Filtered before Python sees a row; ``batch`` sources go to the model at
    once, and one by one if that fails; a source whose calls fail keeps its result.
    """
    for _ in range(rounds):
        left = results.where(X.has_cjk(F.col("unit")) & X.has_cjk(F.col("result"))).select(*UNIT, "unit")

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sources, new = pdf["unit"].tolist(), []
                for start in range(0, len(sources), batch):
                    part = sources[start : start + batch]
                    answer = _ask(model, part)
                    new += answer if answer is not None else [(_ask(model, [t]) or [None])[0] for t in part]
                pdf["again"] = pd.Series(new, index=pdf.index, dtype=object)
                yield pdf.drop(columns="unit")

        schema = ", ".join(f"{c} {t}" for c, t in left.dtypes if c != "unit") + ", again string"
        new = cut_lineage(left.mapInPandas(again, schema)).where("again <> ''").where(~X.has_cjk(F.col("again")))
        results = results.join(new, UNIT, "left").withColumn("result", F.coalesce("again", "result")).drop("again")
    return results


def put_back(all_units: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, page_index, entry_idx, text: each entry's parts in order, translated where there is a result."""
    joined = all_units.select(*UNIT, "unit", "wrapped").join(results.select(*UNIT, "result"), UNIT, "left")
    text = F.coalesce("result", "unit")
    part = F.struct("part_idx", F.when(F.col("wrapped"), F.concat(F.lit("\\text{"), text, F.lit("}"))).otherwise(text).alias("t"))
    return joined.groupBy(*ENTRY).agg(F.array_sort(F.collect_list(part)).alias("ps")).select(*ENTRY, F.array_join(F.col("ps.t"), "").alias("text"))


def translated(entries: DataFrame, model: Model = upper_model, most_items: int = 20, most_bytes: int = 4000, rounds: int = 2, window: int | None = None) -> DataFrame:
    """Entries' texts translated, from taking apart to putting back; by windows of pages the same as at once, if the model's answer to an item doesn't depend on its chunk."""
    every = units(entries)
    return put_back(every, retried(called(chunked(every.where("wanted"), most_items, most_bytes, window), model), model, rounds))


def running_totals(results: DataFrame, window: int = 25) -> DataFrame:
    """For each document and window of pages the units and failures so far."""
    per = results.groupBy("doc_id", F.floor(F.col("page_index") / window).cast("int").alias("window_no")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fell_back").alias("f"))
    so_far = Window.partitionBy("doc_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("doc_id", "window_no", F.sum("n").over(so_far).alias("n_units"), F.sum("f").over(so_far).alias("n_fell_back"))


def hydrated(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows with the stored object that the last part of their key names in their document; ``found`` is null without a key, false if nothing is stored. ``stored(id, name, …)``."""
    name = F.regexp_extract(F.col(key), r"([^/\\\\]+)$", 1)
    objects = stored.select(F.col("id").alias("_id"), F.col("name").alias("_name"), *(c for c in stored.columns if c not in ("id", "name")), F.lit(True).alias("_there"))
    joined = rows.join(objects, (F.col("id") == F.col("_id")) & (name == F.col("_name")), "left")
    return joined.withColumn("found", F.when(F.col(key).isNotNull(), F.coalesce("_there", F.lit(False)))).drop("_id", "_name", "_there")


def resumed(saved: DataFrame, new: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """New pages, with the first pages_done of each document taken from the saved ones, if the checkpoint's page count is the document's and pages_done lies within it.

    ``checkpoints(doc_id, pages_done, page_count, now_pages)``.
    """
    good = checkpoints.where("pages_done > 0 and pages_done <= page_count and page_count = now_pages").select("doc_id", "pages_done")
    old = saved.join(good, "doc_id").where("page_index < pages_done").select(*ENTRY, F.col("text").alias("saved_text"), F.lit(True).alias("hit"))
    return new.join(old, ENTRY, "left").select(*ENTRY, F.when(F.col("hit"), F.col("saved_text")).otherwise(F.col("text")).alias("text"), F.coalesce("hit", F.lit(False)).alias("was_saved"))


def outcome(results: DataFrame) -> DataFrame:
    """For each document its units, how many fell back, and whether nothing was translated."""
    return results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if("fell_back").alias("n_fell_back"), F.bool_and("fell_back").alias("failed"))
