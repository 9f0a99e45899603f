"""Passes over the entries of pages: reading model pages, lifting labels, turning pages back, numbering and leaving out pictures, styles, second readings.

Every comparison is an equi-join on the page with a range as residual; what a
pass decides for a page is an aggregate of the page, joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import page_html
from leafmill.operators.layout import ENTRY, PAGE, first_of_box

# Categories that label a table, that are pictures, and base sizes of translated text in points.
LABELS, PICTURES = ("Caption", "Title", "Section-Header"), ("Image", "Figure", "Picture", "Diagram")
SIZES = {"title": 14.0, "section-header": 12.0, "page-header": 9.0, "page-footer": 9.0, "caption": 10.0, "footnote": 8.5, "list-item": 10.5, "text": 10.5, "table": 10.0, "formula": 11.0, "picture": 11.0}
DEFAULT_SIZE, BOLD, FONT = 10.5, ("title", "section-header", "page-header", "page-footer", "caption"), "Calibri"
READ = "doc_id long, page_index int, entry_idx int, category string, x1 int, y1 int, x2 int, y2 int, text string, source string"


def read_pages_html(pages: DataFrame) -> DataFrame:
    """Entries of ``pages(doc_id, page_index, html, width_px, height_px)``; a page that isn't HTML gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, text, width, height in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (category, place, body, source) in enumerate(page_html.entries_of_page(text, width or 0, height or 0)):
                    rows.append((doc, page, k, category, *place, body, source))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[p.split()[0] for p in READ.split(", ")])

    return pages.select(F.col("doc_id").cast("long"), F.col("page_index").cast("int"), F.col("html").cast("string"), F.col("width_px").cast("int"), F.col("height_px").cast("int")).mapInArrow(run, READ)


def _beside(a: DataFrame, b: DataFrame, test: Column, how: str = "inner") -> DataFrame:
    left = a.select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in PAGE))
    right = b.select(*(F.col(c).alias(f"p_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in PAGE))
    return left.join(right, (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_index") == F.col("p_page_index")) & test, how).drop("p_doc_id", "p_page_index")


def lifted(rows: DataFrame, labels: tuple[str, ...] = LABELS, over: tuple[str, ...] = ("Table",), gap_pt: float = 4.0) -> DataFrame:
    """New boxes of labels that stand in a table: above the topmost table they overlap, ``gap_pt`` away, but not above the page."""
    box = ["entry_idx", "x1", "y1", "x2", "y2"]
    a = rows.where(F.col("category").isin(*labels) & F.col("x1").isNotNull()).select(*PAGE, *box, "zoom")
    b = rows.where(F.col("category").isin(*over) & F.col("x1").isNotNull()).select(*PAGE, *box)
    inside = (F.col("a_x1") < F.col("b_x2")) & (F.col("a_x2") > F.col("b_x1")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("a_y2") > F.col("b_y1")) & (F.col("a_entry_idx") != F.col("b_entry_idx"))
    top = _beside(a, b, inside).groupBy(*PAGE, *(f"a_{c}" for c in (*box, "zoom"))).agg(F.min("b_y1").alias("top"))
    height = (F.col("a_y2") - F.col("a_y1")).cast("double")
    y1 = F.greatest(F.col("top") - gap_pt * F.col("a_zoom") - height, F.lit(0.0))
    return top.select(*PAGE, F.col("a_entry_idx").alias("entry_idx"), F.col("a_x1").alias("x1"), y1.alias("y1"), F.col("a_x2").alias("x2"), (y1 + height).alias("y2"))


def page_angles(rows: DataFrame, share: float = 0.5, neighbour: float = 0.6) -> DataFrame:
    """doc_id, page_index, angle of pages that stand turned: entries turned by 90 or 270 degrees cover ``share`` of the boxed area.

    An entry that isn't turned counts with the first turned one that shares
    ``neighbour`` of its height. The page's angle is the most frequent one of
    the entries counted, 90 of equals.
    """
    area = (F.greatest(F.col("x2") - F.col("x1"), F.lit(0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0))).cast("double")
    boxed = rows.where("x1 is not null").select(*ENTRY, "y1", "y2", "rotation", area.alias("area"))
    turned = boxed.where("rotation in (90, 270)")
    near = (F.col("a_rotation").isin(90, 270) == F.lit(False)) & (F.col("a_area") > 0) & (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1") >= neighbour * F.greatest(F.col("a_y2") - F.col("a_y1"), F.lit(1)))
    # A shuffle on the page serves the join and the aggregation.
    drawn = _beside(boxed.select(*PAGE, "entry_idx", "y1", "y2", "rotation", "area"), turned.select(*PAGE, "entry_idx", "y1", "y2", "rotation"), near).groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx"), F.col("a_area").alias("area")).agg(F.min_by("b_rotation", "b_entry_idx").alias("rotation"))
    counted = turned.select(*ENTRY, "area", "rotation").unionByName(drawn)
    per = counted.groupBy(*PAGE).agg(F.sum("area").alias("turned"), F.count_if(F.col("rotation") == 90).alias("n90"), F.count_if(F.col("rotation") == 270).alias("n270"))
    total = boxed.groupBy(*PAGE).agg(F.sum("area").alias("total"))
    return per.join(total, PAGE).where((F.col("total") > 0) & (F.col("turned") >= share * F.col("total"))).select(*PAGE, F.when(F.col("n90") >= F.col("n270"), 90.0).otherwise(270.0).alias("angle"))


def turned_back(rows: DataFrame, share: float = 0.5, neighbour: float = 0.6) -> DataFrame:
    """Entries of turned pages as they stand when the page is turned back: boxes mapped, sides swapped; ``pixel_rotation`` is what a picture's own pixels still need."""
    w, h = (F.col(c) * F.col("zoom") for c in ("page_width_pt", "page_height_pt"))
    by90 = F.col("angle") == 90
    pick = lambda a, b: F.when(by90, a).otherwise(b)
    return rows.join(page_angles(rows, share, neighbour), PAGE).select(
        *ENTRY, "angle",
        pick(h - F.col("y2"), F.col("y1").cast("double")).alias("x1"), pick(F.col("x1").cast("double"), w - F.col("x2")).alias("y1"),
        pick(h - F.col("y1"), F.col("y2").cast("double")).alias("x2"), pick(F.col("x2").cast("double"), w - F.col("x1")).alias("y2"),
        F.col("page_height_pt").alias("page_width_pt"), F.col("page_width_pt").alias("page_height_pt"),
        F.when(F.col("rotation").isin(90, 270), 0.0).otherwise(F.col("rotation")).alias("rotation"),
        F.when(F.col("category").isin("Image", "Figure", "Picture"), F.col("angle")).alias("pixel_rotation"),
    )


def numbered_pictures(rows: DataFrame) -> DataFrame:
    """Pictures of each page, those of one box once, numbered in entry order, with a name that is the same in every run."""
    once = first_of_box(rows.where(F.col("category").isin(*PICTURES)))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("entry_idx"))
    short = F.substring(F.md5(F.concat_ws("/", *ENTRY)), 1, 6)
    named = once.select(*ENTRY, number.alias("picture_no"), short.alias("short"))
    return named.select(*ENTRY, "picture_no", F.format_string("page%d_pic%d_%s.png", F.col("page_index") + 1, "picture_no", "short").alias("filename"))


def without_pictures(rows: DataFrame) -> DataFrame:
    """Entries but for pictures; diagrams that had become pictures are diagrams again."""
    picture = F.coalesce(F.col("category").isin("Image", "Figure"), F.lit(False))
    was = F.coalesce(F.col("source") == "diagram-recovered", F.lit(False))
    return rows.where(~picture | was).withColumn("category", F.when(picture & was, "Diagram").otherwise(F.col("category")))


def base_styles(rows: DataFrame) -> DataFrame:
    """Font, size and weight of translated text by category."""
    low = F.lower(F.coalesce("category", F.lit("")))
    table = F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair))
    return rows.select(*ENTRY, F.lit(FONT).alias("font"), F.coalesce(F.try_element_at(table, low), F.lit(DEFAULT_SIZE)).alias("size"), low.isin(*BOLD).alias("bold"))


def reread_candidates(tables: DataFrame, rasters: DataFrame, slack: float = 2.0) -> DataFrame:
    """Tables that hold more rasters than their text has picture cells: entry, n_images, n_rasters."""
    box = ["entry_idx", "x1", "y1", "x2", "y2"]
    a = tables.where("x1 is not null").select(*PAGE, *box, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?i)<img\b")).alias("n_images"))
    held = _beside(a, rasters.where("x1 is not null").select(*PAGE, *box), G.contains("a_", "b_", slack) & (F.col("a_entry_idx") != F.col("b_entry_idx")))
    return held.groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx"), F.col("a_n_images").alias("n_images")).agg(F.count(F.lit(1)).alias("n_rasters")).where("n_rasters > n_images")


def reread_taken(old_rows: Column, new_rows: Column, old_images: Column, new_images: Column, rasters: Column) -> Column:
    """True for a second reading of a table that has rows, loses none, and has more pictures than the first, but no more than there are rasters."""
    return (new_rows >= 1) & (new_rows >= old_rows) & (new_images > old_images) & (new_images <= rasters)


def turned_things(things: DataFrame, lines: DataFrame, least: int = 4, share: float = 0.8) -> DataFrame:
    """Things of a page with the lines whose centre lies in them and whether they stand turned: ``least`` lines or more, ``share`` of them higher than wide."""
    box = ["entry_idx", "x1", "y1", "x2", "y2"]
    held = _beside(things.where("x1 is not null").select(*PAGE, *box), lines.where("x1 is not null").select(*PAGE, *box), G.centre_in("a_", "b_"))
    tall = (F.col("b_y2") - F.col("b_y1") > F.col("b_x2") - F.col("b_x1")).cast("double")
    per = held.groupBy(*PAGE, F.col("a_entry_idx").alias("entry_idx")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg(tall), 6).alias("tall_share"))
    return per.withColumn("turned", (F.col("n_lines") >= least) & (F.col("tall_share") >= share))


def detector_scale(width: Column, height: Column, longest: int = 1600) -> Column:
    """By how much a picture is made smaller so that its longer side is no longer than ``longest``."""
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def image_page(width_px: Column, height_px: Column, dpi: float = 96.0) -> list[Column]:
    """Width and height in points and the zoom of the one page that a picture makes."""
    return [(width_px * 72.0 / dpi).alias("page_width_pt"), (height_px * 72.0 / dpi).alias("page_height_pt"), F.lit(dpi / 72.0).alias("zoom")]
