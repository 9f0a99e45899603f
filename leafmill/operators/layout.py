"""Operators on page entries: orders, containment, overlap, neighbours, clusters, styles.

Entries are rows (doc_id, page_index, entry_idx, x1, y1, x2, y2, category,
text, rotation, …). Every comparison of two entries is within one page: the
joins are equi-joins on (doc_id, page_index) with a range as the residual
condition, so no plan has a nested loop over all entries, and a page bounds
the pairs. Boxes that aren't four numbers have null corners and take no part
in comparisons.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

PAGE = ["doc_id", "page_index"]
ENTRY = [*PAGE, "entry_idx"]
# Categories by their use.
PICTURES, HEADERS_FOOTERS = ("Image", "Figure", "Picture"), ("Page-Header", "Page-Footer")


def entries(page_entries: DataFrame, by: tuple[str, ...] = tuple(PAGE)) -> DataFrame:
    """Entries with corners turned right, the category in one spelling, repeated rows once, and the page's defaults filled in.

    Rows are spread by ``by`` at once; what follows groups, orders and joins
    by it, and finds the rows in place: by page, or by document alone.
    """
    x1, y1, x2, y2 = G.corners(F.col("bbox"))
    names = F.array_join(F.transform(F.split(F.trim("category"), "[-_ ]+"), lambda w: F.initcap(w)), "-")
    used = [*ENTRY, "category", "text", "bbox", "rotation", "source", "page_width_pt", "page_height_pt", "zoom"]
    return page_entries.select(*used).repartition(*by).dropDuplicates(ENTRY).select(
        *ENTRY, F.nullif(names, F.lit("")).alias("category"), "text", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        G.quarter_turn(F.col("rotation")).alias("rotation"), "source",
        F.coalesce(F.nullif("page_width_pt", F.lit(0.0)), F.lit(595.0)).alias("page_width_pt"),
        F.coalesce(F.nullif("page_height_pt", F.lit(0.0)), F.lit(842.0)).alias("page_height_pt"),
        F.coalesce(F.nullif("zoom", F.lit(0.0)), F.lit(1.0)).alias("zoom"),
    )


def reading_key(rotation: Column | None = None) -> list[Column]:
    """Sort keys of the reading order: top to bottom, then left to right; on turned pages along the turned axis; missing boxes first."""
    x1, y1, y2 = (F.coalesce(F.col(c), F.lit(0)) for c in ("x1", "y1", "y2"))
    if rotation is None:
        return [y1, x1]
    return [F.when(rotation == 90, x1).when(rotation == 270, -x1).otherwise(y1), F.when(rotation == 90, -y2).when(rotation == 270, y1).otherwise(x1)]


def reading_order(rows: DataFrame, turned: bool = False) -> DataFrame:
    """The place of each entry in its page's reading order, from 0; ties by entry_idx."""
    keys = reading_key(F.col("rotation") if turned else None)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*keys, "entry_idx")) - 1)


def _pairs(a: DataFrame, b: DataFrame, how: str = "inner", on: Column | None = None, distinct: bool = True) -> DataFrame:
    left = a.select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in PAGE))
    right = b.select(*(F.col(c).alias(f"p_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in PAGE))
    test = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index"))
    if distinct:
        test &= F.col("a_entry_idx") != F.col("b_entry_idx")
    return left.join(right, test if on is None else test & on, how).drop("p_doc_id", "p_page_index")


_BOX = ["entry_idx", "x1", "y1", "x2", "y2"]


def overlapping(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs of entries of a page, smaller entry_idx first, whose intersection over union reaches ``least``."""
    slim = rows.select(*PAGE, *_BOX)
    ratio = G.intersection_over_union("a_", "b_")
    near = (G.shared("a_", "b_", "x") > 0) & (G.shared("a_", "b_", "y") > 0) & (F.col("a_entry_idx") < F.col("b_entry_idx"))
    return _pairs(slim, slim, on=near).withColumn("iou", ratio).where(F.col("iou") >= least).select(*PAGE, "a_entry_idx", "b_entry_idx", F.round("iou", 6).alias("iou"))


def overlaps_per_page(rows: DataFrame, slack_emu: int = 9144) -> DataFrame:
    """Pairs of boxes of each page that share more than ``slack_emu`` on both axes."""
    slim = rows.select(*PAGE, "entry_idx", *(G.to_emu(F.col(c), F.col("zoom")).alias(c) for c in ("x1", "y1", "x2", "y2")))
    test = (G.shared("a_", "b_", "x") > slack_emu) & (G.shared("a_", "b_", "y") > slack_emu) & (F.col("a_entry_idx") < F.col("b_entry_idx"))
    return _pairs(slim, slim, on=test).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_overlaps"))


def owners(inner: DataFrame, outer: DataFrame, slack: float = 2.0) -> DataFrame:
    """The first entry of ``outer``, in entry order, that contains each entry of ``inner``."""
    test = G.contains("b_", "a_", slack)
    return _pairs(inner.select(*PAGE, *_BOX), outer.select(*PAGE, *_BOX), on=test).groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx")).agg(F.min("b_entry_idx").alias("owner_idx"))


def outside(inner: DataFrame, outer: DataFrame, slack: float = 2.0) -> DataFrame:
    """Entries of ``inner`` that no entry of ``outer`` contains."""
    kept = inner.select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in _BOX))
    right = outer.select(*(F.col(c).alias(f"p_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    test = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index")) & (F.col("a_entry_idx") != F.col("b_entry_idx")) & G.contains("b_", "a_", slack)
    return kept.join(right, test, "left_anti").select(*PAGE, F.col("a_entry_idx").alias("entry_idx"))


def room(rows: DataFrame, side: str) -> DataFrame:
    """Free room of each entry below it or to its right: the distance to the nearest entry that overlaps it on the other axis; null if nothing stands there."""
    along, across = ("y", "x") if side == "below" else ("x", "y")
    slim = rows.select(*PAGE, *_BOX).where("x1 is not null")
    test = (F.col(f"b_{along}1") >= F.col(f"a_{along}2")) & (G.shared("a_", "b_", across) > 0)
    return (
        _pairs(slim, slim, "left", test).groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx"))
        .agg((F.min(f"b_{along}1") - F.first(f"a_{along}2")).alias("room"))
    )


def first_of_box(rows: DataFrame) -> DataFrame:
    """Entries with one box on a page once: the first in entry order; entries without a box all stay."""
    boxed = rows.where("x1 is not null")
    first = boxed.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE, "x1", "y1", "x2", "y2").orderBy("entry_idx"))).where("_n = 1").drop("_n")
    return first.unionByName(rows.where("x1 is null"))


def insert_places(new: DataFrame, rows: DataFrame) -> DataFrame:
    """Where each new entry goes into its page: before the first entry that begins below it, else at the end."""
    test = F.col("b_y1") > F.col("a_y1")
    below = _pairs(new.select(*PAGE, *_BOX), rows.select(*PAGE, *_BOX), "left", test, distinct=False).groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx")).agg(F.min("b_entry_idx").alias("before"))
    ends = rows.groupBy(*PAGE).agg((F.max("entry_idx") + 1).alias("end"))
    return below.join(ends, PAGE, "left").select(*PAGE, "entry_idx", F.coalesce("before", "end", F.lit(0)).alias("place"))


def dominant(spans: DataFrame, keys: list[str], group: list[str], order: str, weight: Column) -> DataFrame:
    """The style of each group that most weight stands in, ties to the one seen first; pre-aggregated by style before ranking."""
    sums = spans.groupBy(*group, *keys).agg(F.sum(weight).alias("weight"), F.min(order).alias("_seen"))
    best = Window.partitionBy(*group).orderBy(F.col("weight").desc(), F.col("_seen").asc())
    return sums.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_seen")


def tall_pages(rows: DataFrame, least_lines: int = 4, share: float = 0.8) -> DataFrame:
    """For each page its boxes and the share of them higher than wide, and whether the page is turned by that."""
    t = rows.where("x1 is not null").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_boxes"), F.round(F.avg(((F.col("y2") - F.col("y1")) > (F.col("x2") - F.col("x1"))).cast("double")), 6).alias("tall_share"))
    return t.withColumn("turned", (F.col("n_boxes") >= least_lines) & (F.col("tall_share") >= share))


def turned_area(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """The share of a page's boxed area that stands turned, and whether the whole page counts as turned."""
    a = G.area()
    t = rows.where("x1 is not null").groupBy(*PAGE).agg(F.sum(F.when(F.col("rotation") != 0, a).otherwise(0.0)).alias("turned"), F.sum(a).alias("total"))
    ratio = F.round(F.when(F.col("total") > 0, F.col("turned") / F.col("total")).otherwise(0.0), 6)
    return t.select(*PAGE, ratio.alias("turned_share"), (ratio >= share).alias("page_turned"))


def derotated(rows: DataFrame) -> DataFrame:
    """Boxes and page sides of turned entries as they stand when the page is turned back by 90 or 270 degrees; in pixels."""
    w, h = (F.bround(F.col(c) * F.col("zoom")).cast("int") for c in ("page_width_pt", "page_height_pt"))
    by90, by270 = F.col("rotation") == 90, F.col("rotation") == 270
    pick = lambda a, b, c: F.when(by90, a).when(by270, b).otherwise(c)
    return rows.where("x1 is not null").select(
        *ENTRY, "rotation",
        pick(h - F.col("y2"), F.col("y1"), F.col("x1")).alias("x1"), pick(F.col("x1"), w - F.col("x2"), F.col("y1")).alias("y1"),
        pick(h - F.col("y1"), F.col("y2"), F.col("x2")).alias("x2"), pick(F.col("x2"), w - F.col("x1"), F.col("y2")).alias("y2"),
        F.when(by90 | by270, h).otherwise(w).alias("page_width_px"), F.when(by90 | by270, w).otherwise(h).alias("page_height_px"),
    )


# What stands before and after the text of a category in Markdown; all others stand bare.
MARKDOWN = {
    "Page-Header": ("## ", ""), "Section-Header": ("## ", ""), "Title": ("# ", ""), "Equation-Block": ("$$\n", "\n$$"), "Formula": ("$$\n", "\n$$"), "Code-Block": ("```\n", "\n```"),
    "Chemical-Block": ("```\n", "\n```"), "Form": ("```\n", "\n```"), "Diagram": ("```mermaid\n", "\n```"), "Caption": ("*", "*"), "Page-Footer": ("^", "^"), "Footnote": ("^", "^"),
}


def markdown(rows: DataFrame) -> DataFrame:
    """Each document's entries as Markdown, page by page in reading order, an empty line after each.

    Pictures are named by their ``image_url``, if rows have it, else as
    detected, with their text as the alternative; a table that isn't markup is
    marked as one; entries without text are left out; a category that isn't
    known stands as plain text.
    """
    text, category = F.coalesce("text", F.lit("")), F.col("category")
    url = F.coalesce(F.col("image_url") if "image_url" in rows.columns else F.lit(None), F.lit("Image detected"))
    alt = F.when(F.trim(text) == "", "Image").otherwise(F.trim(text))
    body = F.when(category.isin("Image", "Figure"), F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")")))
    body = body.when((category == "Table") & ~F.trim(text).startswith("<"), F.concat(F.lit("**Table:** "), text))
    for name, (before, after) in MARKDOWN.items():
        body = body.when(category == name, F.concat(F.lit(before), text, F.lit(after)))
    picture = F.coalesce(category.isin("Image", "Figure"), F.lit(False))
    keys = reading_key()
    # A document's entries make one string; the document bounds the list.
    blocks = rows.where(picture | (text != "")).select("doc_id", F.struct("page_index", keys[0].alias("a"), keys[1].alias("b"), "entry_idx", F.concat(body.otherwise(text), F.lit("\n")).alias("body")).alias("e"))
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es")).select("doc_id", F.array_join(F.col("es.body"), "\n").alias("markdown"))


def page_windows(rows: DataFrame, size: int = 32) -> DataFrame:
    """Pages and entries of each run of ``size`` pages."""
    return rows.groupBy("doc_id", F.floor(F.col("page_index") / size).cast("int").alias("window_no")).agg(F.countDistinct("page_index").alias("n_pages"), F.count(F.lit(1)).alias("n_entries"))


def empty_share(rows: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """Documents of more than ``least`` entries of which more than ``share`` have no text, pictures left out."""
    t = rows.where(~F.coalesce(F.col("category").isin(*PICTURES), F.lit(False))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"))
    return t.where((F.col("n_entries") > least) & (F.col("n_empty") > share * F.col("n_entries")))


def connected(rows: DataFrame, gap: float = 0.6) -> DataFrame:
    """Clusters of a page's boxes: two are linked if they share an axis and lie nearer than ``gap`` heights on the other; each entry gets its cluster's smallest entry_idx.

    Links are transitive. A page bounds the group, so each is one small table in a task.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_idx", ignore_index=True)
        parent = list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        x1, y1, x2, y2 = (pdf[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        for i in range(len(pdf)):
            reach = gap * min(y2[i] - y1[i], x2[i] - x1[i])
            for j in range(i + 1, len(pdf)):
                dx, dy = max(x1[i], x1[j]) - min(x2[i], x2[j]), max(y1[i], y1[j]) - min(y2[i], y2[j])
                if dx <= 0 and dy <= reach or dy <= 0 and dx <= reach:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        idx = pdf["entry_idx"].to_numpy()
        return pdf[["doc_id", "page_index", "entry_idx"]].assign(cluster=[idx[root(i)] for i in range(len(pdf))])

    boxed = rows.where("x1 is not null").select(*PAGE, *_BOX)
    return boxed.groupBy(*PAGE).applyInPandas(link, "doc_id long, page_index int, entry_idx int, cluster int")


def cluster_boxes(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """The box around each cluster and its texts in reading order."""
    joined = rows.select(*ENTRY, "x1", "y1", "x2", "y2", "text").join(clusters, ENTRY)
    return joined.groupBy(*PAGE, "cluster").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_entries"),
    )
