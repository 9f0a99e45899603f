"""Queries over page entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import layout
from leafmill.sources import table

#: Pixels by which an entry may stand out of the one that holds it: lines of a page lie so near.
SLACK = 90.0


def _entries(spark, folder):
    return layout.entries(table(spark, folder, "page_entries"))


def _by_document(spark, folder):
    """Entries for what groups by document: spread by it alone, so that nothing is shuffled again."""
    return layout.entries(table(spark, folder, "page_entries"), ("doc_id",))


def entries_clean(spark, folder):
    """Every entry once, with corners, category and angle in one form."""
    return _entries(spark, folder).select(*layout.ENTRY, "category", "x1", "y1", "x2", "y2", "rotation", "zoom")


def entry_orders(spark, folder):
    """Every entry's place in the reading order, plain and turned."""
    plain = layout.reading_order(_entries(spark, folder)).withColumnRenamed("place", "plain_place")
    return layout.reading_order(plain, turned=True).select(*layout.ENTRY, "plain_place", "place")


def entry_overlaps(spark, folder):
    """Pairs of entries that overlap by a hundredth."""
    return layout.overlapping(_entries(spark, folder), 0.01)


def page_overlaps(spark, folder):
    return layout.overlaps_per_page(_entries(spark, folder))


def entry_owner(spark, folder):
    """The first other entry around each entry of recovered text."""
    e = _entries(spark, folder)
    return layout.owners(e.where("source is not null"), e.where("source is null"), SLACK)


def entry_outside(spark, folder):
    """Entries of recovered text that no other entry contains."""
    e = _entries(spark, folder)
    return layout.outside(e.where("source is not null"), e.where("source is null"), SLACK)


def room_below(spark, folder):
    return layout.room(_entries(spark, folder), "below")


def room_right(spark, folder):
    return layout.room(_entries(spark, folder), "right")


def entry_first_of_box(spark, folder):
    return layout.first_of_box(_entries(spark, folder)).select(*layout.ENTRY)


def insert_places(spark, folder):
    """Where entries of recovered text would go among the others."""
    e = _entries(spark, folder)
    return layout.insert_places(e.where("source is not null"), e.where("source is null"))


def category_dominant(spark, folder):
    """The category that holds most characters of each page."""
    e = _entries(spark, folder).where("category is not null")
    return layout.dominant(e, ["category"], layout.PAGE, "entry_idx", F.length(F.coalesce("text", F.lit(""))))


def tall_pages(spark, folder):
    return layout.tall_pages(_entries(spark, folder))


def turned_pages(spark, folder):
    return layout.turned_area(_entries(spark, folder))


def entries_derotated(spark, folder):
    return layout.derotated(_entries(spark, folder))


def page_markdown(spark, folder):
    return layout.markdown(_by_document(spark, folder))


def page_windows(spark, folder):
    return layout.page_windows(_by_document(spark, folder), 4)


def empty_documents(spark, folder):
    return layout.empty_share(_by_document(spark, folder), 2, 0.02)


def entry_units(spark, folder):
    """Boxes in EMU, on a grid of 1000, and the third of the page they stand in."""
    e = _entries(spark, folder).where("x1 is not null")
    width = F.col("page_width_pt") * F.col("zoom")
    return e.select(*layout.ENTRY, G.to_emu(F.col("x1"), F.col("zoom")).alias("x_emu"), G.rescaled(F.col("y1"), F.col("page_height_pt").cast("int")).alias("y_grid"), G.third(F.col("x1"), F.col("x2"), width).alias("third"))


def entry_clusters(spark, folder):
    """Clusters of boxes of each page."""
    return layout.connected(_entries(spark, folder))


def cluster_boxes(spark, folder):
    e = _entries(spark, folder)
    return layout.cluster_boxes(e, layout.connected(e))


_NAMES = """entries_clean entry_orders entry_overlaps page_overlaps entry_owner entry_outside room_below room_right entry_first_of_box insert_places category_dominant
tall_pages turned_pages entries_derotated page_markdown page_windows empty_documents entry_units entry_clusters cluster_boxes""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_E = """e AS (
    SELECT doc_id, page_index, entry_idx, text, source, least(b1, b3) AS x1, least(b2, b4) AS y1, greatest(b1, b3) AS x2, greatest(b2, b4) AS y2,
        nullif(array_to_string(list_transform(regexp_split_to_array(trim(category), '[-_ ]+'), lambda w: upper(w[1]) || lower(w[2:])), '-'), '') AS category,
        CASE WHEN rotation IS NULL OR isnan(rotation) THEN 0.0 ELSE ((CAST(rotation AS DOUBLE) % 360) + 360) % 360 END AS rotation,
        coalesce(nullif(page_width_pt, 0), 595.0) AS page_width_pt, coalesce(nullif(page_height_pt, 0), 842.0) AS page_height_pt, coalesce(nullif(zoom, 0), 1.0) AS zoom
    FROM (SELECT DISTINCT ON (doc_id, page_index, entry_idx) *, CASE WHEN len(bbox) = 4 THEN bbox[1] END AS b1, CASE WHEN len(bbox) = 4 THEN bbox[2] END AS b2,
        CASE WHEN len(bbox) = 4 THEN bbox[3] END AS b3, CASE WHEN len(bbox) = 4 THEN bbox[4] END AS b4 FROM page_entries))"""
_SX = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)"
_SY = "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_PAIR = "e a JOIN e b ON a.doc_id = b.doc_id AND a.page_index = b.page_index"
_IN = f"a.x1 >= b.x1 - {SLACK} AND a.y1 >= b.y1 - {SLACK} AND a.x2 <= b.x2 + {SLACK} AND a.y2 <= b.y2 + {SLACK}"
_MARKS = " ".join("WHEN '{}' THEN {} || t || {}".format(c, *("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in marks)) for c, marks in layout.MARKDOWN.items())
_BODY = f"CASE WHEN category IN ('Image', 'Figure') THEN '![' || CASE WHEN trim(t) = '' THEN 'Image' ELSE trim(t) END || '](Image detected)' WHEN category = 'Table' AND trim(t)[1] <> '<' THEN '**Table:** ' || t ELSE CASE category {_MARKS} ELSE t END END || chr(10)"


def _room(along: str, other: str) -> str:
    shared = _SX if other == "x" else _SY
    return f"""WITH {_E}, f AS (SELECT * FROM e WHERE x1 IS NOT NULL)
        SELECT a.doc_id, a.page_index, a.entry_idx, min(b.{along}1) - any_value(a.{along}2) AS room FROM f a LEFT JOIN f b
        ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.entry_idx <> b.entry_idx AND b.{along}1 >= a.{along}2 AND {shared} > 0 GROUP BY ALL"""


_LINKED = f"""{_E}, f AS (SELECT *, 0.6::DOUBLE * least(y2 - y1, x2 - x1) AS reach FROM e WHERE x1 IS NOT NULL),
    d AS (SELECT a.doc_id, a.page_index, a.entry_idx AS i, b.entry_idx AS j, a.reach, greatest(a.x1, b.x1) - least(a.x2, b.x2) AS dx, greatest(a.y1, b.y1) - least(a.y2, b.y2) AS dy
        FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.entry_idx < b.entry_idx),
    k AS (SELECT doc_id, page_index, i, j FROM d WHERE (dx <= 0 AND dy <= reach) OR (dy <= 0 AND dx <= reach)), l AS (SELECT * FROM k UNION ALL SELECT doc_id, page_index, j, i FROM k),
    c AS (SELECT doc_id, page_index, entry_idx, entry_idx AS root FROM f UNION SELECT c.doc_id, c.page_index, l.j, c.root FROM c JOIN l ON l.doc_id = c.doc_id AND l.page_index = c.page_index AND l.i = c.entry_idx)"""
SQL = {
    "entries_clean": f"WITH {_E} SELECT doc_id, page_index, entry_idx, category, x1, y1, x2, y2, rotation, zoom FROM e",
    "entry_orders": f"""WITH {_E}, k AS (SELECT *, coalesce(x1, 0) AS u, coalesce(y1, 0) AS v, coalesce(y2, 0) AS w FROM e)
        SELECT doc_id, page_index, entry_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY v, u, entry_idx) - 1 AS INTEGER) AS plain_place,
        CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE rotation WHEN 90 THEN u WHEN 270 THEN -u ELSE v END, CASE rotation WHEN 90 THEN -w WHEN 270 THEN v ELSE u END, entry_idx) - 1 AS INTEGER) AS place FROM k""",
    "entry_overlaps": f"""WITH {_E}, p AS (SELECT a.doc_id, a.page_index, a.entry_idx AS a_entry_idx, b.entry_idx AS b_entry_idx, CAST({_SX} * {_SY} AS DOUBLE) AS i,
        CAST((a.x2 - a.x1) * (a.y2 - a.y1) AS DOUBLE) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM {_PAIR} AND a.entry_idx < b.entry_idx WHERE {_SX} > 0 AND {_SY} > 0)
        SELECT doc_id, page_index, a_entry_idx, b_entry_idx, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.01""",
    "page_overlaps": f"""WITH {_E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT doc_id, page_index, entry_idx, CAST(round_even(x1 / zoom * 12700, 0) AS BIGINT) AS x1, CAST(round_even(y1 / zoom * 12700, 0) AS BIGINT) AS y1,
        CAST(round_even(x2 / zoom * 12700, 0) AS BIGINT) AS x2, CAST(round_even(y2 / zoom * 12700, 0) AS BIGINT) AS y2 FROM e0)
        SELECT a.doc_id, a.page_index, count(*) AS n_overlaps FROM {_PAIR} AND a.entry_idx < b.entry_idx WHERE {_SX} > 9144 AND {_SY} > 9144 GROUP BY ALL""",
    "entry_owner": f"WITH {_E} SELECT a.doc_id, a.page_index, a.entry_idx, min(b.entry_idx) AS owner_idx FROM {_PAIR} WHERE a.source IS NOT NULL AND b.source IS NULL AND a.entry_idx <> b.entry_idx AND {_IN} GROUP BY ALL",
    "entry_outside": f"""WITH {_E} SELECT a.doc_id, a.page_index, a.entry_idx FROM e a WHERE a.source IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM e b WHERE a.doc_id = b.doc_id AND a.page_index = b.page_index AND b.source IS NULL AND a.entry_idx <> b.entry_idx AND {_IN})""",
    "room_below": _room("y", "x"),
    "room_right": _room("x", "y"),
    "entry_first_of_box": f"WITH {_E} SELECT doc_id, page_index, entry_idx FROM e QUALIFY x1 IS NULL OR row_number() OVER (PARTITION BY doc_id, page_index, x1, y1, x2, y2 ORDER BY entry_idx) = 1",
    "insert_places": f"""WITH {_E}, o AS (SELECT * FROM e WHERE source IS NULL), ends AS (SELECT doc_id, page_index, max(entry_idx) + 1 AS last FROM o GROUP BY ALL),
        m AS (SELECT a.doc_id, a.page_index, a.entry_idx, min(b.entry_idx) AS before FROM (SELECT * FROM e WHERE source IS NOT NULL) a LEFT JOIN o b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND b.y1 > a.y1 GROUP BY ALL)
        SELECT doc_id, page_index, entry_idx, coalesce(before, last, 0) AS place FROM m LEFT JOIN ends USING (doc_id, page_index)""",
    "category_dominant": f"""WITH {_E}, s AS (SELECT doc_id, page_index, category, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS weight, min(entry_idx) AS seen FROM e WHERE category IS NOT NULL GROUP BY ALL)
        SELECT doc_id, page_index, category, weight FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY weight DESC, seen) = 1""",
    "tall_pages": f"""WITH {_E}, t AS (SELECT doc_id, page_index, count(*) AS n_boxes, round(avg(CASE WHEN y2 - y1 > x2 - x1 THEN 1.0 ELSE 0.0 END), 6) AS tall_share FROM e WHERE x1 IS NOT NULL GROUP BY ALL)
        SELECT *, n_boxes >= 4 AND tall_share >= 0.8 AS turned FROM t""",
    "turned_pages": f"""WITH {_E}, t AS (SELECT doc_id, page_index, sum(CASE WHEN rotation <> 0 THEN CAST(x2 - x1 AS DOUBLE) * (y2 - y1) ELSE 0 END) AS a, sum(CAST(x2 - x1 AS DOUBLE) * (y2 - y1)) AS b FROM e WHERE x1 IS NOT NULL GROUP BY ALL)
        SELECT doc_id, page_index, round(CASE WHEN b > 0 THEN a / b ELSE 0.0 END, 6) AS turned_share, round(CASE WHEN b > 0 THEN a / b ELSE 0.0 END, 6) >= 0.5 AS page_turned FROM t""",
    "entries_derotated": f"""WITH {_E}, p AS (SELECT *, CAST(round_even(page_width_pt * zoom, 0) AS INTEGER) AS w, CAST(round_even(page_height_pt * zoom, 0) AS INTEGER) AS h FROM e WHERE x1 IS NOT NULL)
        SELECT doc_id, page_index, entry_idx, rotation, CASE rotation WHEN 90 THEN h - y2 WHEN 270 THEN y1 ELSE x1 END AS x1, CASE rotation WHEN 90 THEN x1 WHEN 270 THEN w - x2 ELSE y1 END AS y1,
        CASE rotation WHEN 90 THEN h - y1 WHEN 270 THEN y2 ELSE x2 END AS x2, CASE rotation WHEN 90 THEN x2 WHEN 270 THEN w - x1 ELSE y2 END AS y2,
        CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS page_width_px, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS page_height_px FROM p""",
    "page_markdown": f"""WITH {_E}, k AS (SELECT *, coalesce(text, '') AS t FROM e)
        SELECT doc_id, string_agg({_BODY}, chr(10) ORDER BY page_index, coalesce(y1, 0), coalesce(x1, 0), entry_idx) AS markdown FROM k WHERE t <> '' OR category IN ('Image', 'Figure') GROUP BY doc_id""",
    "entry_clusters": f"WITH RECURSIVE {_LINKED} SELECT doc_id, page_index, entry_idx, min(root) AS cluster FROM c GROUP BY ALL",
    "cluster_boxes": f"""WITH RECURSIVE {_LINKED}, m AS (SELECT doc_id, page_index, entry_idx, min(root) AS cluster FROM c GROUP BY ALL)
        SELECT doc_id, page_index, cluster, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_entries FROM m JOIN f USING (doc_id, page_index, entry_idx) GROUP BY ALL""",
    "page_windows": f"WITH {_E} SELECT doc_id, CAST(floor(page_index / 4) AS INTEGER) AS window_no, count(DISTINCT page_index) AS n_pages, count(*) AS n_entries FROM e GROUP BY ALL",
    "empty_documents": f"""WITH {_E}, t AS (SELECT doc_id, count(*) AS n_entries, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty FROM e WHERE coalesce(category, '') NOT IN ('Image', 'Figure', 'Picture') GROUP BY ALL)
        SELECT * FROM t WHERE n_entries > 2 AND n_empty > 0.02 * n_entries""",
    "entry_units": f"""WITH {_E}, f AS (SELECT *, ((x1 + x2) / 2.0) / nullif(page_width_pt * zoom, 0) AS share FROM e WHERE x1 IS NOT NULL)
        SELECT doc_id, page_index, entry_idx, CAST(round_even(CAST(x1 AS DOUBLE) / zoom * 12700, 0) AS BIGINT) AS x_emu,
        CAST(greatest(0, least(CAST(page_height_pt AS INTEGER), round_even(CAST(y1 AS DOUBLE) * CAST(page_height_pt AS INTEGER) / 1000, 0))) AS INTEGER) AS y_grid,
        CASE WHEN share > CAST(2 AS DOUBLE) / 3 THEN 'right' WHEN share >= CAST(1 AS DOUBLE) / 3 THEN 'center' ELSE 'left' END AS third FROM f""",
}
