"""Operators that give entries what a first reading missed: styles, captions, boxes, turned lines, pictures, rules.

A first, cheap predicate picks the candidates; only those would go to a model,
which the caller passes in; a guard decides whether its answer is taken.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.operators.layout import ENTRY, PAGE, dominant

# Categories whose text may be a line of a form.
FORM_CATEGORIES = ("Text", "List-Group", "Form", "Caption")
TEXT_CATEGORIES = ("Text", "Section-Header", "List-Group", "Caption", "Footnote", "Page-Header", "Page-Footer", "Form", "Title", "Table-Of-Contents", "Complex-Block", "Bibliography")


def styled(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The style that most characters of each entry have, from the spans whose centre lies in its box; a span counts for the first such entry.

    ``spans(doc_id, page_index, span_idx, x1, y1, x2, y2, n_chars, *keys)``.
    """
    a = spans.select(*PAGE, "span_idx", "n_chars", *keys, *(F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = rows.where("x1 is not null").select(*(F.col(c).alias(f"p_{c}") for c in PAGE), "entry_idx", *(F.col(c).alias(f"e_{c}") for c in ("x1", "y1", "x2", "y2")))
    test = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index")) & G.centre_in("e_", "s_")
    owned = a.join(b, test).groupBy(*PAGE, "span_idx", *keys, "n_chars").agg(F.min("entry_idx").alias("entry_idx"))
    return dominant(owned, keys, ENTRY, "span_idx", F.col("n_chars"))


def captions(rows: DataFrame, slack: float = 40.0) -> DataFrame:
    """The table or picture that each caption belongs to: the nearest above or below it on the page that shares its columns, within ``slack`` pixels a zoom of one."""
    cap = rows.where("category = 'Caption' and x1 is not null").select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in ("entry_idx", "x1", "y1", "x2", "y2", "zoom")))
    thing = rows.where("category in ('Table', 'Image', 'Figure', 'Form') and x1 is not null").select(*(F.col(c).alias(f"p_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in ("entry_idx", "x1", "y1", "x2", "y2")))
    gap = F.greatest(F.col("b_y1") - F.col("a_y2"), F.col("a_y1") - F.col("b_y2"), F.lit(0))
    test = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index")) & (G.shared("a_", "b_", "x") > 0) & (gap <= slack * F.col("a_zoom"))
    near = cap.join(thing, test).groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx")).agg(F.min(F.struct(gap.alias("gap"), F.col("b_entry_idx").alias("idx"))).alias("best"))
    return near.select(*PAGE, "entry_idx", F.col("best.idx").alias("owner_idx"), F.col("best.gap").alias("gap"))


def box_candidates(rows: DataFrame) -> DataFrame:
    """Entries of forms that name a pair of options and show no box."""
    return rows.where(F.col("category").isin(*FORM_CATEGORIES) & X.box_hint(F.col("text")))


def taken_boxes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Second readings that are taken: they show boxes, and the first one's letters and digits all stand in them in order. ``new(*ENTRY, new_text)``."""
    good = (X.boxes(F.col("new_text")) > 0) & F.contains(X.signature(F.col("new_text")), X.signature(F.col("text")))
    return old.join(new, ENTRY).where(good).select(*ENTRY, "new_text")


def turn_candidates(rows: DataFrame) -> DataFrame:
    """Entries of text that may stand turned: of a text category, two characters or more, not yet turned, and twice as high as wide."""
    return rows.where(F.col("category").isin(*TEXT_CATEGORIES) & (F.length(F.trim("text")) >= 2) & (F.col("rotation") == 0) & ((F.col("y2") - F.col("y1")) >= 2 * (F.col("x2") - F.col("x1"))))


def lost_pictures(rasters: DataFrame, rows: DataFrame, least_pt: float = 12.0, same: float = 0.4) -> DataFrame:
    """Rasters, ``least_pt`` points wide and high at least, that stand in no entry's place: none of the page overlaps them by ``same``."""
    wide = (F.col("x2") - F.col("x1") >= least_pt * F.col("zoom")) & (F.col("y2") - F.col("y1") >= least_pt * F.col("zoom"))
    a = rasters.where(wide).select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in ("entry_idx", "x1", "y1", "x2", "y2")))
    b = rows.select(*(F.col(c).alias(f"p_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in ("entry_idx", "x1", "y1", "x2", "y2")))
    test = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index")) & (F.col("a_entry_idx") != F.col("b_entry_idx")) & (G.intersection_over_union("a_", "b_") >= same)
    return a.join(b, test, "left_anti").select(*PAGE, F.col("a_entry_idx").alias("entry_idx"))


def merged_rules(rules: DataFrame, group: list[str], at: str, nearer: float = 8.0) -> DataFrame:
    """Positions of rules with neighbours nearer than ``nearer`` made one: the first of each run and how many it holds."""
    order = Window.partitionBy(*group).orderBy(at)
    run = F.sum(F.coalesce((F.col(at) - F.lag(at).over(order) >= nearer).cast("int"), F.lit(1))).over(order)
    return rules.withColumn("run", run).groupBy(*group, "run").agg(F.min(at).alias("position"), F.count(F.lit(1)).alias("n_rules")).drop("run")


def scan_types(entries: DataFrame, least: int = 32) -> DataFrame:
    """native for documents of which any page has ``least`` characters, its entries one below the other, else scanned."""
    stripped = F.trim(F.coalesce("text", F.lit("")))
    pages = entries.groupBy(*PAGE).agg((F.sum(F.length(stripped)) + F.count_if(stripped != "") - 1).alias("n_chars"))
    return pages.groupBy("doc_id").agg(F.when(F.bool_or(F.col("n_chars") >= least), "native").otherwise("scanned").alias("scan_type"))


def read_pages(pages: DataFrame, reader: Callable[..., str], attempts: int = 7, step: float = 0.2, hottest: float = 0.8) -> DataFrame:
    """``pages(doc_id, page_index, …)`` with the reader's ``text``, or ``error`` of the last attempt; a page that fails leaves the others alone.

    A reader of two arguments is given the temperature, which rises by ``step``
    from attempt to attempt. A timeout is the reader's to raise.
    """
    heated = len(inspect.signature(reader).parameters) > 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for row in pdf.to_dict("records"):
                text = error = None
                for n in range(attempts):
                    try:
                        text, error = reader(row, min(step * n, hottest)) if heated else reader(row), None
                        break
                    except Exception as e:  # noqa: BLE001 — becomes the row's error
                        error = str(e)[:200]
                texts.append(text)
                errors.append(error)
            yield pdf[PAGE].assign(text=texts, error=errors)

    return pages.mapInPandas(run, "doc_id long, page_index int, text string, error string")
