"""Recognised tables as rows of cells, and what is measured on them.

A table is one string of one row, so parsing and placing are narrow maps over
Arrow batches: no shuffle, and a table is the largest unit in memory. What is
counted or compared over cells afterwards is plain aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import grid as G
from leafmill.functions.markup_table import read_table

CELLS = "table_id string, row_no int, col_no int, text string, colspan int, rowspan int, is_header boolean, images int, nested boolean"
RAW = "table_id string, row_no int, pos int, text string, colspan int, rowspan int, is_header boolean, images int"
HEALTH = "table_id string, cols int, n_rows int, full_rows int, emitted int, placed int, widest_row int, degenerate boolean, truncated boolean, missing_columns boolean, healthy boolean"
WEIGHTS = "table_id string, col_no int, weight int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _mapped(tables: DataFrame, rows_of: Callable[[str, str | None], Iterator[tuple]], schema: str) -> DataFrame:
    arrow = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(key, text)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return tables.select(F.col("table_id").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


def _raw(key: str, text: str | None) -> Iterator[tuple]:
    for r, (cells, header) in enumerate(read_table(text)):
        for k, c in enumerate(cells):
            yield key, r, k, c.text, c.colspan, c.rowspan, header, c.images


def _placed(key: str, text: str | None) -> Iterator[tuple]:
    for p in G.build(read_table(text)).anchored():
        yield key, p.row, p.col, p.cell.text, p.colspan, p.rowspan, p.header, p.cell.images, any(k == "table" for k, _ in p.cell.blocks)


def _health(key: str, text: str | None) -> Iterator[tuple]:
    if text is not None:
        yield key, *G.health(text).values()


def _weights(key: str, text: str | None) -> Iterator[tuple]:
    for c, w in enumerate(G.column_weights(G.build(read_table(text)))):
        yield key, c, w


def raw_cells(tables: DataFrame) -> DataFrame:
    """Cells of ``tables(table_id, html)`` as they are written, repeated rows once."""
    return _mapped(tables, _raw, RAW)


def cells(tables: DataFrame) -> DataFrame:
    """Cells placed on the repaired grid."""
    return _mapped(tables, _placed, CELLS)


def health(tables: DataFrame) -> DataFrame:
    """Shape and defects of every table."""
    return _mapped(tables, _health, HEALTH)


def weights(tables: DataFrame) -> DataFrame:
    """Weight of every column of every table."""
    return _mapped(tables, _weights, WEIGHTS)


def covered(placed: DataFrame) -> DataFrame:
    """Squares that cells cover: one row each, with the cell's own place."""
    return placed.select(
        "table_id", F.col("row_no").alias("cell_row"), F.col("col_no").alias("cell_col"),
        F.explode(F.sequence("row_no", F.col("row_no") + F.col("rowspan") - 1)).alias("row_no"), "col_no", "colspan",
    ).select("table_id", "cell_row", "cell_col", "row_no", F.explode(F.sequence("col_no", F.col("col_no") + F.col("colspan") - 1)).alias("col_no"))


def full_columns(tables: DataFrame) -> DataFrame:
    """Columns in which every row of a table's grid that has a cell of its own has one; read once a table."""

    def columns(key: str, text: str | None) -> Iterator[tuple]:
        rows: dict[int, set[int]] = {}
        placed = G.build(read_table(text)).anchored()
        for p in placed:
            rows.setdefault(p.col, set()).add(p.row)
        every = {p.row for p in placed}
        for c in sorted(rows):
            if rows[c] == every:
                yield key, c

    return _mapped(tables, columns, "table_id string, col_no int")


def header_groups(tables: DataFrame) -> DataFrame:
    """table_id, col_no, width of the filled cells of each table's first row, stretched over the empty ones to their right that the row below fills."""
    return _mapped(tables, lambda key, text: ((key, c, w) for c, w in G.headers_over_groups(G.build(read_table(text)))), "table_id string, col_no int, width int")


def pictures_placed(tables: DataFrame, pictures: DataFrame) -> DataFrame:
    """table_id, picture_no, row_no, col_no: the cell of each picture that finds one, for ``tables(table_id, html, width, height)`` and ``pictures(table_id, picture_no, x, y)`` by their centres within the table.

    The nearest pairs first, each cell taking as many as it names images. A
    table's pictures are listed beside it; the table bounds the list.
    """
    listed = pictures.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("picture_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("ps"))
    rows = tables.select("table_id", F.col("html").cast("string"), F.col("width").cast("double"), F.col("height").cast("double")).join(listed, "table_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, width, height, ps in zip(*(c.to_pylist() for c in batch.columns)):
                placed = G.pictures_to_cells(G.build(read_table(text)), [(p["x"], p["y"]) for p in ps], width, height)
                out += [(key, ps[i]["picture_no"], row, col) for i, row, col in placed]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["table_id", "picture_no", "row_no", "col_no"])

    return rows.mapInArrow(run, "table_id string, picture_no int, row_no int, col_no int")


def _score(h: dict) -> tuple:
    share = lambda a, b: round(a / b, 3) if b else 0.0
    return (not h["degenerate"], not h["missing_columns"], share(h["placed"], h["emitted"]), share(h["full_rows"], h["n_rows"]), h["placed"])


def judged(pairs: DataFrame) -> DataFrame:
    """table_id, kept, better, taken of ``pairs(table_id, old, new)``, two readings of a table.

    ``kept``: no value of the old cells vanishes in the new ones or loses too
    many copies. ``better``: the new one's health beats the old one's, by
    degeneracy, missing columns, placed share, full share and placed cells in
    this order. ``taken``: both. Null where a reading is null. Both readings
    stand in one row, so they are compared where they are read.
    """
    arrow = pa.schema([("table_id", pa.string()), *((c, pa.bool_()) for c in ("kept", "better", "taken"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, better = [], []
            for old, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if old is None or new is None or old == new:
                    kept.append(None if old is None or new is None else True)
                    better.append(None if old is None or new is None else False)
                    continue
                # Each reading is parsed and placed once.
                a, b = ((rows, G.build(rows)) for rows in (read_table(old), read_table(new)))
                kept.append(G.keeps_values(G.signatures(a[1]), G.signatures(b[1])))
                better.append(_score(G.health(new, read=b)) > _score(G.health(old, read=a)))
            taken = [None if k is None else k and b for k, b in zip(kept, better)]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.bool_()) for c in (kept, better, taken))], schema=arrow)

    slim = pairs.select(F.col("table_id").cast("string"), F.col("old").cast("string"), F.col("new").cast("string"))
    return slim.mapInArrow(run, "table_id string, kept boolean, better boolean, taken boolean")


def chains(tables: DataFrame, gap_pt: float = 60.0) -> DataFrame:
    """table_id, chain_id: tables that go on from page to page.

    ``tables(doc_id, table_id, page_index, entry_idx, y1, zoom, cols, has_head, header_y2)``. A table goes on
    the one before it if it is the first of its page, has as many columns, has
    no head of its own, and begins within ``gap_pt`` points of the page's top
    or header. The chain's id is the table_id of its first table.
    """
    order = Window.partitionBy("doc_id").orderBy("page_index", "entry_idx")
    first_of_page = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("entry_idx")) == 1
    parsed = tables.withColumn("first", first_of_page).where("cols > 0")
    near = (F.col("y1") - F.coalesce("header_y2", F.lit(0))) <= gap_pt * F.col("zoom")
    goes_on = F.coalesce(F.col("first") & (F.lag("cols").over(order) == F.col("cols")) & ~F.col("has_head") & near, F.lit(False))
    started = parsed.withColumn("start", (~goes_on).cast("int")).withColumn("chain_no", F.sum("start").over(order))
    # The first table of a chain names it.
    named = F.first("table_id").over(Window.partitionBy("doc_id", "chain_no").orderBy("page_index", "entry_idx"))
    return started.select("doc_id", "table_id", named.alias("chain_id"))
