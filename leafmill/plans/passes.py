"""Queries over passes of pages and over measures with stated ties, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import layout, measures, nested, passes, records, translate
from leafmill.plans.general import _PAGES
from leafmill.plans.general import SQL as _GENERAL
from leafmill.plans.layout import _E
from leafmill.sources import table

PAGE, ENTRY = layout.PAGE, layout.ENTRY


def _entries(spark, folder):
    return layout.entries(table(spark, folder, "page_entries"))


def _layout_entries(spark, folder):
    """Entries of layouts, the first of those with one place."""
    rows = nested.flat_tables(nested.occurrences(table(spark, folder, "documents")))["entries"]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*ENTRY).orderBy("page_pos"))).where("_k = 1").drop("_k")


def page_html_entries(spark, folder):
    """Pages of entries written as a model writes them, in blocks with label and box, and read as entries again."""
    e = _entries(spark, folder).where("x1 is not null")
    sides = [F.max(F.bround(F.col(c) * F.col("zoom")).cast("int")).over(Window.partitionBy(*PAGE)) for c in ("page_width_pt", "page_height_pt")]
    grid = [F.bround(F.col(c) * 1000.0 / side).cast("int") for c, side in zip(("x1", "y1", "x2", "y2"), sides * 2)]
    text = F.coalesce("text", F.lit(""))
    plain = X.xml_escaped(text)
    items = F.filter(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != "")
    body = (
        F.when(F.col("category").isin("Image", "Figure"), F.concat(F.lit('<img src="x.png" alt="'), F.replace(plain, F.lit('"'), F.lit("&quot;")), F.lit('"/>')))
        .when(F.col("category") == "Table", F.replace(text, F.lit("<td>"), F.lit('<td data-bbox="1 2 3 4">')))
        .when(F.col("category") == "Equation-Block", F.concat(F.lit("<math display='block'>"), plain, F.lit("</math>")))
        .when(F.col("category") == "List-Group", F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>")))
        .otherwise(F.concat(F.lit("<p>"), plain, F.lit("</p>")))
    )
    label = F.when(F.col("category").isNotNull(), F.concat(F.lit(' data-label="'), F.col("category"), F.lit('"'))).otherwise("")
    div = F.concat(F.lit('<div data-bbox="'), F.concat_ws(" ", *grid), F.lit('"'), label, F.lit(">"), body, F.lit("</div>"))
    pages = e.select(*PAGE, sides[0].alias("width_px"), sides[1].alias("height_px"), F.struct("entry_idx", div.alias("div")).alias("d"))
    # A page's entries make one string; the page bounds the list.
    pages = pages.groupBy(*PAGE).agg(F.max("width_px").alias("width_px"), F.max("height_px").alias("height_px"), F.array_join(F.array_sort(F.collect_list("d"))["div"], "\n").alias("html"))
    return passes.read_pages_html(pages)


def labels_lifted(spark, folder):
    """Labels that stand in another block, lifted above it."""
    return passes.lifted(_layout_entries(spark, folder).where("x2 is not null and y2 is not null").withColumn("zoom", F.lit(2.0)), ("Caption", "Title", "Section-Header", "Text"), ("Table", "Image"))


def pages_turned_back(spark, folder):
    """Entries of pages that stand turned, as they stand when the page is turned back."""
    return passes.turned_back(_entries(spark, folder), 0.02)


def pictures_numbered(spark, folder):
    return passes.numbered_pictures(_layout_entries(spark, folder))


def pictures_off(spark, folder):
    """Entries without pictures; recovered diagrams stay as text."""
    e = _entries(spark, folder).withColumn("source", F.when(F.col("entry_idx") % 2 == 0, "diagram-recovered"))
    return passes.without_pictures(e).select(*ENTRY, "category")


def base_styles(spark, folder):
    return passes.base_styles(_entries(spark, folder))


def reread_candidates(spark, folder):
    """Blocks that hold more other entries than their text has pictures."""
    e = _entries(spark, folder)
    return passes.reread_candidates(e.where("source is null"), e, 90.0)


def turned_zones(spark, folder):
    """Quarters of a page's height with the lines in them, and whether they stand turned."""
    e = _entries(spark, folder).where("x1 is not null")
    sides = e.groupBy(*PAGE).agg(F.max(F.col("page_height_pt") * F.col("zoom")).alias("h"), F.max(F.col("page_width_pt") * F.col("zoom")).alias("w"))
    zones = sides.withColumn("entry_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(*PAGE, "entry_idx", F.lit(0.0).alias("x1"), (F.col("h") / 4 * F.col("entry_idx")).alias("y1"), F.col("w").alias("x2"), (F.col("h") / 4 * (F.col("entry_idx") + 1)).alias("y2"))
    return passes.turned_things(zones, e, 2, 0.5)


def detector_boxes(spark, folder):
    """Boxes as a detector sees them in a smaller picture, and back in the page's pixels."""
    e = _entries(spark, folder).where("x1 is not null")
    scale = passes.detector_scale(F.col("page_width_pt") * F.col("zoom"), F.col("page_height_pt") * F.col("zoom"))
    small = e.select(*ENTRY, scale.alias("scale"), *(F.bround(F.col(c) * scale).cast("int").alias(f"small_{c}") for c in ("x1", "y1", "x2", "y2")))
    return small.select(*ENTRY, *(f"small_{c}" for c in ("x1", "y1", "x2", "y2")), *(F.bround(F.col(f"small_{c}") / F.col("scale")).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


def image_pages(spark, folder):
    """The page that a picture of each page's size makes."""
    e = _entries(spark, folder)
    px = e.groupBy(*PAGE).agg(F.max(F.bround(F.col("page_width_pt") * F.col("zoom"))).alias("w"), F.max(F.bround(F.col("page_height_pt") * F.col("zoom"))).alias("h"))
    return px.select(*PAGE, *passes.image_page(F.col("w"), F.col("h")))


def images_hydrated(spark, folder):
    """Pictures of layouts with the stored object that their key names; every other document has its objects."""
    bridge = nested.occurrences(table(spark, folder, "documents"))
    entries = nested.flat_tables(bridge)["entries"].where("image_key is not null").select(F.col("doc_id").alias("id"), "page_pos", "entry_idx", "image_key")
    stored = entries.where("id % 2 = 0").select("id", F.regexp_extract("image_key", r"([^/\\]+)$", 1).alias("name"), F.length("image_key").alias("size")).distinct()
    return translate.hydrated(entries, stored, "image_key").withColumnRenamed("id", "doc_id")


def owned_translations(spark, folder):
    """Translations in a state, where no owner is given: the state doesn't count."""
    jobs = table(spark, folder, "translations").dropDuplicates(["id"])
    return records.where_owned(jobs, None, "ok").select("id", "status")


def ids_marked(spark, folder):
    """Records of the feed whose id, with every seventh made wrong, is no UUID."""
    feed = table(spark, folder, "change_feed").select("feed_id", F.when(F.col("feed_id") % 7 == 0, F.concat(F.lit("x"), "rec_id")).otherwise(F.col("rec_id")).alias("rec_id"))
    return records.by_id_policy(feed, "rec_id", "mark")


def page_batches(spark, folder):
    """Calls that each document's pages take by its kind of scan, and whether it has more than 20 pages."""
    size = F.coalesce(F.try_element_at(F.create_map(F.lit("native"), F.lit(16), F.lit("scanned"), F.lit(4)), F.col("scan_type")), F.lit(2))
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.ceil(F.coalesce("page_count", F.lit(0)) / size).cast("long").alias("n_batches"), (F.coalesce("page_count", F.lit(0)) > 20).alias("too_long"))


def rotation_modes(spark, folder):
    """The most frequent angle of each document's entries, the smaller of equals."""
    return measures.smallest_mode(_entries(spark, folder), ["doc_id"], "rotation")


def category_shares(spark, folder):
    return measures.top_share(_entries(spark, folder), ["doc_id"], "category", 10)


def height_medians(spark, folder):
    """The upper median of the heights of each page's entries."""
    e = _entries(spark, folder)
    return measures.upper_median(e.withColumn("height", F.col("y2") - F.col("y1")), PAGE, "height")


def largest_tables(spark, folder):
    """The entry of each document with most lines, as the reader of a table takes the one with most rows."""
    e = _entries(spark, folder)
    flat = e.withColumn("place", F.col("page_index") * 100000 + F.col("entry_idx"))
    return measures.largest(flat, ["doc_id"], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?i)<tr\b|\n")), "place")


def tallest_entries(spark, folder):
    e = _entries(spark, folder).where("x1 is not null")
    return measures.tallest(e, PAGE, F.col("y2") - F.col("y1"), "entry_idx", 3)


def page_bands(spark, folder):
    """Stretches of a page's height that entries cover."""
    return measures.bands(_entries(spark, folder), PAGE, "y1", "y2", 8.0)


def words_kept(spark, folder):
    """Whether the next page of a document has every category at least as often."""
    e = _entries(spark, folder)
    return measures.superset(e, e.withColumn("page_index", F.col("page_index") - 1), PAGE, "category")


_NAMES = """page_html_entries labels_lifted pages_turned_back pictures_numbered pictures_off base_styles reread_candidates turned_zones detector_boxes image_pages images_hydrated owned_translations
ids_marked page_batches rotation_modes category_shares height_medians largest_tables tallest_entries page_bands words_kept""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SQUEEZED = f"trim(regexp_replace(t, '{_BLANK}', ' ', 'g'))"
_TURNED = "rotation IN (90, 270)"
_SIZE = " ".join(f"WHEN '{c}' THEN {s}::DOUBLE" for c, s in passes.SIZES.items())
_BOX = ("x1", "y1", "x2", "y2")
_L = f"l AS ({_GENERAL['p1_entries']}), e AS (SELECT *, 2.0::DOUBLE AS zoom FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, entry_idx ORDER BY page_pos) = 1)"
SQL = {
    "page_html_entries": rf"""WITH {_E}, s AS (SELECT *, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t, max(CAST(round_even(page_width_pt * zoom, 0) AS INTEGER)) OVER p AS w, max(CAST(round_even(page_height_pt * zoom, 0) AS INTEGER)) OVER p AS h,
            row_number() OVER (PARTITION BY doc_id, page_index ORDER BY entry_idx) - 1 AS place FROM e WHERE x1 IS NOT NULL AND coalesce(category, '') <> 'Blank-Page' WINDOW p AS (PARTITION BY doc_id, page_index)),
        b AS (SELECT *, {", ".join(f"CAST(greatest(0, least({side}, round_even(round_even({c} * 1000.0::DOUBLE / {side}, 0) * ({side} / 1000.0::DOUBLE), 0))) AS INTEGER) AS new_{c}" for c, side in zip(_BOX, "whwh"))} FROM s)
        SELECT doc_id, page_index, CAST(place AS INTEGER) AS entry_idx, CASE category WHEN 'Diagram' THEN 'Image' ELSE coalesce(category, 'Text') END AS category, {", ".join(f"new_{c} AS {c}" for c in _BOX)},
            CASE WHEN category IN ('Image', 'Figure') THEN t WHEN category = 'Table' THEN regexp_replace(raw, '(?is)<math\b[^>]*>\s*(.*?)\s*</math>', '$\1$', 'g')
                WHEN category = 'Equation-Block' THEN trim(regexp_replace(replace(t, '$', ''), '{_BLANK}', ' ', 'g'))
                WHEN category = 'List-Group' THEN array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '{_BLANK}', ' ', 'g'))), lambda x: x <> ''), lambda x: '- ' || x), chr(10))
                ELSE {_SQUEEZED} END AS text, CASE category WHEN 'Diagram' THEN 'diagram-recovered' END AS source FROM b""",
    "labels_lifted": f"""WITH {_L}, p AS (SELECT a.doc_id, a.page_index, a.entry_idx, a.x1, a.y1, a.x2, a.y2, a.zoom, min(b.y1) AS top FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.entry_idx <> b.entry_idx
            WHERE a.category IN ('Caption', 'Title', 'Section-Header', 'Text') AND b.category IN ('Table', 'Image') AND a.x2 IS NOT NULL AND a.y2 IS NOT NULL AND b.x2 IS NOT NULL AND b.y2 IS NOT NULL AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY ALL),
        n AS (SELECT *, greatest(top - 4.0::DOUBLE * zoom - (y2 - y1)::DOUBLE, 0.0::DOUBLE) AS n1 FROM p) SELECT doc_id, page_index, entry_idx, x1, n1 AS y1, x2, n1 + (y2 - y1) AS y2 FROM n""",
    "pages_turned_back": f"""WITH {_E}, f AS (SELECT *, CASE WHEN least(abs(rotation - round_even(rotation / 90, 0) * 90), 360 - abs(rotation - round_even(rotation / 90, 0) * 90)) <= 5 THEN (round_even(rotation / 90, 0) * 90) % 360 ELSE rotation END AS r,
            greatest(x2 - x1, 0)::DOUBLE * greatest(y2 - y1, 0) AS area FROM e WHERE x1 IS NOT NULL),
        d AS (SELECT a.doc_id, a.page_index, a.entry_idx, a.area, arg_min(b.r, b.entry_idx) AS r FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page_index = b.page_index
            WHERE a.r NOT IN (90, 270) AND b.r IN (90, 270) AND a.area > 0 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) >= 0.6::DOUBLE * greatest(a.y2 - a.y1, 1) GROUP BY ALL),
        c AS (SELECT doc_id, page_index, entry_idx, area, r FROM f WHERE r IN (90, 270) UNION ALL SELECT * FROM d),
        g AS (SELECT doc_id, page_index, sum(area) AS turned, CASE WHEN count(*) FILTER (r = 90) >= count(*) FILTER (r = 270) THEN 90.0::DOUBLE ELSE 270.0::DOUBLE END AS angle FROM c GROUP BY ALL),
        t AS (SELECT doc_id, page_index, sum(area) AS total FROM f GROUP BY ALL), k AS (SELECT doc_id, page_index, angle FROM g JOIN t USING (doc_id, page_index) WHERE total > 0 AND turned >= 0.02::DOUBLE * total),
        q AS (SELECT e.*, CASE WHEN least(abs(rotation - round_even(rotation / 90, 0) * 90), 360 - abs(rotation - round_even(rotation / 90, 0) * 90)) <= 5 THEN (round_even(rotation / 90, 0) * 90) % 360 ELSE rotation END AS r FROM e)
        SELECT doc_id, page_index, entry_idx, angle, CASE angle WHEN 90 THEN page_height_pt * zoom - y2 ELSE y1 END AS x1, CASE angle WHEN 90 THEN x1 ELSE page_width_pt * zoom - x2 END AS y1,
            CASE angle WHEN 90 THEN page_height_pt * zoom - y1 ELSE y2 END AS x2, CASE angle WHEN 90 THEN x2 ELSE page_width_pt * zoom - x1 END AS y2, page_height_pt AS page_width_pt, page_width_pt AS page_height_pt,
            CASE WHEN r IN (90, 270) THEN 0.0::DOUBLE ELSE r END AS rotation, CASE WHEN category IN ('Image', 'Figure', 'Picture') THEN angle END AS pixel_rotation FROM q JOIN k USING (doc_id, page_index)""",
    "pictures_numbered": f"""WITH {_L}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, x1, y1, x2, y2 ORDER BY entry_idx) AS k FROM e WHERE category IN {passes.PICTURES}),
        n AS (SELECT doc_id, page_index, entry_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY entry_idx) AS INTEGER) AS picture_no FROM p WHERE x1 IS NULL OR k = 1)
        SELECT *, 'page' || (page_index + 1) || '_pic' || picture_no || '_' || substr(md5(doc_id || '/' || page_index || '/' || entry_idx), 1, 6) || '.png' AS filename FROM n""",
    "pictures_off": f"WITH {_E} SELECT doc_id, page_index, entry_idx, CASE WHEN category IN ('Image', 'Figure') THEN 'Diagram' ELSE category END AS category FROM e WHERE coalesce(category, '') NOT IN ('Image', 'Figure') OR entry_idx % 2 = 0",
    "base_styles": f"WITH {_E} SELECT doc_id, page_index, entry_idx, 'Calibri' AS font, CASE lower(coalesce(category, '')) {_SIZE} ELSE 10.5::DOUBLE END AS size, lower(coalesce(category, '')) IN {passes.BOLD} AS bold FROM e",
    "reread_candidates": f"""WITH {_E} SELECT a.doc_id, a.page_index, a.entry_idx, CAST(len(regexp_extract_all(coalesce(any_value(a.text), ''), '(?i)<img\\b')) AS INTEGER) AS n_images, count(*) AS n_rasters FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.entry_idx <> b.entry_idx
        WHERE a.source IS NULL AND b.x1 >= a.x1 - 90 AND b.y1 >= a.y1 - 90 AND b.x2 <= a.x2 + 90 AND b.y2 <= a.y2 + 90 GROUP BY a.doc_id, a.page_index, a.entry_idx HAVING count(*) > len(regexp_extract_all(coalesce(any_value(a.text), ''), '(?i)<img\\b'))""",
    "turned_zones": f"""WITH {_E}, s AS (SELECT doc_id, page_index, max(page_height_pt * zoom) AS h, max(page_width_pt * zoom) AS w FROM e WHERE x1 IS NOT NULL GROUP BY ALL), q AS (SELECT unnest([0, 1, 2, 3]) AS q),
        l AS (SELECT e.doc_id, e.page_index, q.q AS entry_idx, CASE WHEN e.y2 - e.y1 > e.x2 - e.x1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tall FROM e JOIN s USING (doc_id, page_index), q
            WHERE (y1 + y2) / 2 >= h / 4 * q AND (y1 + y2) / 2 <= h / 4 * (q + 1) AND (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 <= w)
        SELECT doc_id, page_index, entry_idx, count(*) AS n_lines, round(avg(tall), 6) AS tall_share, count(*) >= 2 AND round(avg(tall), 6) >= 0.5 AS turned FROM l GROUP BY ALL""",
    "detector_boxes": f"""WITH {_E}, s AS (SELECT *, least(1.0::DOUBLE, 1600.0::DOUBLE / greatest(page_width_pt * zoom, page_height_pt * zoom)) AS k FROM e WHERE x1 IS NOT NULL),
        m AS (SELECT doc_id, page_index, entry_idx, k, {", ".join(f"CAST(round_even({c} * k, 0) AS INTEGER) AS small_{c}" for c in _BOX)} FROM s)
        SELECT doc_id, page_index, entry_idx, {", ".join(f"small_{c}, CAST(round_even(small_{c} / k, 0) AS INTEGER) AS {c}" for c in _BOX)} FROM m""",
    "image_pages": f"""WITH {_E}, p AS (SELECT doc_id, page_index, max(round_even(page_width_pt * zoom, 0)) AS w, max(round_even(page_height_pt * zoom, 0)) AS h FROM e GROUP BY ALL)
        SELECT doc_id, page_index, w * 72.0::DOUBLE / 96.0::DOUBLE AS page_width_pt, h * 72.0::DOUBLE / 96.0::DOUBLE AS page_height_pt, 96.0::DOUBLE / 72.0::DOUBLE AS zoom FROM p""",
    "images_hydrated": rf"""WITH {_PAGES}, k AS (SELECT doc_id, page_pos, entry_idx, e ->> '$.image_key' AS image_key FROM entries WHERE json_type(e) = 'OBJECT' AND e ->> '$.image_key' IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, regexp_extract(image_key, '([^/\\]+)$', 1) AS name, CAST(length(image_key) AS INTEGER) AS size FROM k WHERE doc_id % 2 = 0)
        SELECT k.*, s.size, s.doc_id IS NOT NULL AS found FROM k LEFT JOIN s ON s.doc_id = k.doc_id AND s.name = regexp_extract(image_key, '([^/\\]+)$', 1)""",
    "owned_translations": "SELECT DISTINCT id, status FROM translations",
    "ids_marked": """WITH f AS (SELECT feed_id, CASE WHEN feed_id % 7 = 0 THEN 'x' || rec_id ELSE rec_id END AS rec_id FROM change_feed)
        SELECT *, CASE WHEN NOT coalesce(regexp_matches(rec_id, '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'), false) THEN 'not an id: ' || coalesce(rec_id, 'null') END AS error FROM f""",
    "page_batches": "SELECT doc_id, CAST(ceil(coalesce(page_count, 0) / CASE scan_type WHEN 'native' THEN 16.0 WHEN 'scanned' THEN 4.0 ELSE 2.0 END) AS BIGINT) AS n_batches, coalesce(page_count, 0) > 20 AS too_long FROM documents",
    "rotation_modes": f"""WITH {_E}, r AS (SELECT doc_id, CASE WHEN least(abs(rotation - round_even(rotation / 90, 0) * 90), 360 - abs(rotation - round_even(rotation / 90, 0) * 90)) <= 5 THEN (round_even(rotation / 90, 0) * 90) % 360 ELSE rotation END AS rotation FROM e),
        n AS (SELECT doc_id, rotation, count(*) AS n FROM r GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rotation) = 1""",
    "category_shares": f"""WITH {_E}, n AS (SELECT doc_id, category, count(*) AS n FROM e WHERE category IS NOT NULL GROUP BY ALL), t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_values, max(n) AS most FROM n GROUP BY doc_id)
        SELECT doc_id, n_values, round(most / n_values, 6) AS top_share, most > 0.7 * n_values AS degenerate FROM t WHERE n_values >= 10""",
    "height_medians": f"WITH {_E} SELECT doc_id, page_index, list_sort(list(y2 - y1))[len(list(y2 - y1)) // 2 + 1] AS upper_median FROM e WHERE x1 IS NOT NULL GROUP BY ALL",
    "largest_tables": f"""WITH {_E}, s AS (SELECT doc_id, page_index * 100000 + entry_idx AS place, CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)<tr\\b|\\n')) AS INTEGER) AS size FROM e)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place) = 1""",
    "tallest_entries": f"WITH {_E} SELECT doc_id, page_index, entry_idx, y2 - y1 AS size, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y2 - y1 DESC, entry_idx) AS INTEGER) AS rank FROM e WHERE x1 IS NOT NULL QUALIFY rank <= 3",
    "page_bands": f"""WITH {_E}, s AS (SELECT doc_id, page_index, entry_idx, y1, y2, max(y2) OVER (PARTITION BY doc_id, page_index ORDER BY y1, y2, entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE y1 IS NOT NULL),
        b AS (SELECT *, sum(CASE WHEN y1 <= reach + 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_index ORDER BY y1, y2, entry_idx ROWS UNBOUNDED PRECEDING) AS band FROM s)
        SELECT doc_id, page_index, CAST(band AS BIGINT) AS band, min(y1) AS "from", max(y2) AS "to", count(*) AS n FROM b GROUP BY ALL""",
    "words_kept": f"""WITH {_E}, n AS (SELECT doc_id, page_index, category, count(*) AS n FROM e WHERE category IS NOT NULL GROUP BY ALL), l AS (SELECT a.doc_id, a.page_index, greatest(a.n - coalesce(b.n, 0), 0) AS lack FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.page_index = a.page_index + 1 AND b.category = a.category)
        SELECT doc_id, page_index, sum(lack) = 0 AS kept, CAST(sum(lack) AS BIGINT) AS n_lacking FROM l GROUP BY ALL""",
}
