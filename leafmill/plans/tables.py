"""Queries over tables: those that pages hold, and tables made of order lines, whose shape SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import grid as G
from leafmill.operators import layout, tables
from leafmill.sources import table


def _page_tables(spark, folder):
    e = layout.entries(table(spark, folder, "page_entries")).where(F.lower("text").contains("<table"))
    return e.select(F.concat_ws("/", *layout.ENTRY).alias("table_id"), F.col("text").alias("html"), "doc_id", "page_index", "entry_idx", "y1", "zoom")


def _lines(spark, folder, by="l_orderkey"):
    """Order lines, spread by what makes a table of them; reading tables is work for processors, so small partitions aren't made one."""
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)


def _tag(name, *columns):
    return F.concat(*(x for c in columns for x in (F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))))


def _order_tables(spark, folder):
    """A table for each order: a row for each line with number, part and flag."""
    cells = F.concat(F.lit("<tr>"), _tag("td", "l_linenumber", "l_partkey", "l_returnflag"), F.lit("</tr>"))
    listed = _lines(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("tr")))).alias("rs"))
    return listed.select(F.col("l_orderkey").cast("string").alias("table_id"), F.concat(F.lit("<table>"), F.array_join(F.col("rs.tr"), ""), F.lit("</table>")).alias("html"))


def _run_together(spark, folder):
    """A table for each supplier whose rows all ran together into one."""
    listed = _lines(spark, folder, "l_suppkey").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", _tag("td", "l_partkey", "l_returnflag").alias("td")))).alias("rs"))
    return listed.select(F.col("l_suppkey").cast("string").alias("table_id"), F.concat(F.lit("<table><tr>"), F.array_join(F.col("rs.td"), ""), F.lit("</tr></table>")).alias("html"))


def table_raw_cells(spark, folder):
    """Cells of all tables of pages as written."""
    return tables.raw_cells(_page_tables(spark, folder))


def table_cells(spark, folder):
    """Cells of all tables of pages on their grids."""
    return tables.cells(_page_tables(spark, folder))


def table_health(spark, folder):
    return tables.health(_page_tables(spark, folder))


def order_table_cells(spark, folder):
    return tables.cells(_order_tables(spark, folder)).select("table_id", "row_no", "col_no", "text")


def order_table_health(spark, folder):
    return tables.health(_order_tables(spark, folder)).select("table_id", "cols", "n_rows", "full_rows", "emitted", "placed", "widest_row", "healthy")


def run_together_health(spark, folder):
    return tables.health(_run_together(spark, folder)).select("table_id", "cols", "n_rows", "emitted", "placed", "widest_row", "healthy")


def order_table_weights(spark, folder):
    return tables.weights(_order_tables(spark, folder))


def name_table_weights(spark, folder):
    """Column weights of tables of fifty parts each: a name of two words and a sentence that holds it."""
    p = table(spark, folder, "part").select((F.floor(F.col("p_partkey") / 50)).alias("k"), "p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_type", F.lit("with"), "p_brand", F.lit("of"), "p_size").alias("said"))
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    tr = F.concat(F.lit("<tr>"), _tag("td", "p_name", "said"), F.lit("</tr>"))
    listed = p.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p_partkey", tr.alias("tr")))).alias("rs"))
    return tables.weights(listed.select(F.col("k").cast("string").alias("table_id"), F.concat(F.lit("<table>"), F.array_join("rs.tr", ""), F.lit("</table>")).alias("html")))


def picture_cells(spark, folder):
    """The cells of pictures that stand where each order's table has them, a row for each line."""
    li = _lines(spark, folder).select("l_orderkey", F.col("l_linenumber").alias("n")).distinct()
    listed = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("ns", lambda n: F.concat(F.lit("<tr><td>"), n.cast("string"), F.lit("</td><td><img src='x'/></td></tr>"))), ""), F.lit("</table>"))
    key = F.col("l_orderkey").cast("string").alias("table_id")
    pictures = listed.select(key, F.posexplode("ns").alias("at", "picture_no")).select("table_id", F.col("picture_no").cast("int").alias("picture_no"), F.lit(75.0).alias("x"), (F.col("at") * 10.0 + 4.0).alias("y"))
    return tables.pictures_placed(listed.select(key, html.alias("html"), F.lit(100.0).alias("width"), (F.size("ns") * 10.0).alias("height")), pictures)


def header_groups(spark, folder):
    """First rows of orders' tables whose one name stands over all columns."""
    t = _order_tables(spark, folder)
    return tables.header_groups(t.withColumn("html", F.replace("html", F.lit("<table>"), F.lit("<table><tr><th>lines</th><th></th><th></th></tr>"))))


def _readings(spark, folder):
    """Both readings of each order's table, listed by one aggregation."""
    cells = lambda flag: F.concat(F.lit("<tr>"), F.concat(*(x for c in (F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), flag) for x in (F.lit("<td>"), c, F.lit("</td>")))), F.lit("</tr>"))
    changed = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), F.lit("Q")).otherwise(F.col("l_returnflag"))
    lost = (F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 3 == 0)
    rows = _lines(spark, folder)
    one = rows.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", cells(F.col("l_returnflag")).alias("tr")))).alias("old"),
        F.array_sort(F.collect_list(F.when(~lost, F.struct("l_linenumber", cells(changed).alias("tr"))))).alias("new"),
    )
    html = lambda c: F.concat(F.lit("<table>"), F.array_join(F.col(f"{c}.tr"), ""), F.lit("</table>"))
    return one.select(F.col("l_orderkey").cast("string").alias("table_id"), html("old").alias("old"), F.when(F.size("new") > 0, html("new")).alias("new"))


def content_kept(spark, folder):
    """Whether a second reading of each order's table keeps its content."""
    return tables.judged(_readings(spark, folder)).select("table_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def reading_better(spark, folder):
    """Whether a second reading of each order's table is the healthier one."""
    return tables.judged(_readings(spark, folder)).where("better is not null").select("table_id", "better")


def reading_taken(spark, folder):
    """Which reading of two suppliers' tables is taken: the second one parts the cells that had run together in the first."""
    listed = _lines(spark, folder, "l_suppkey").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", _tag("td", "l_partkey", "l_returnflag").alias("td")))).alias("rs"))
    old = F.concat(F.lit("<table><tr>"), F.array_join("rs.td", ""), F.lit("</tr></table>"))
    new = F.concat(F.lit("<table><tr>"), F.array_join(F.slice(F.col("rs.td"), 1, 190), "</tr><tr>"), F.lit("</tr></table>"))
    return tables.judged(listed.select(F.col("l_suppkey").cast("string").alias("table_id"), old.alias("old"), new.alias("new"))).select("table_id", "better")


def canonical_columns(spark, folder):
    """Columns that every row of a table covers from its own edge."""
    return tables.full_columns(_page_tables(spark, folder))


def _span_tables(spark, folder):
    """A table for each customer: the customer over all rows, then each order with its number, its state over two columns and its date."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    td = F.concat(F.lit("<td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td colspan='2'>"), F.col("o_orderstatus"), F.lit("</td><td>"), F.col("o_totalprice").cast("string"), F.lit("</td>"))
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", td.alias("td")))).alias("rs"))
    rows = F.transform("rs", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("rs").cast("string"), F.lit('">c'), F.col("o_custkey").cast("string"), F.lit("</td>"))).otherwise(""), r["td"], F.lit("</tr>")))
    return listed.select(F.col("o_custkey").cast("string").alias("table_id"), F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def span_table_cells(spark, folder):
    """Cells of tables with spans in both directions, placed."""
    return tables.cells(_span_tables(spark, folder)).select("table_id", "row_no", "col_no", "text", "colspan", "rowspan")


def span_table_squares(spark, folder):
    """Squares that the cells of tables with spans cover."""
    return tables.covered(tables.cells(_span_tables(spark, folder)))


def covered_squares(spark, folder):
    """How many squares the cells of each table of pages cover."""
    return tables.covered(tables.cells(_page_tables(spark, folder))).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_squares"))


def _chain_input(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    from pyspark.sql import Window

    page = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", F.floor(F.col("o_orderkey") / 2)))
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), page.alias("page_index"), F.col("o_orderkey").alias("entry_idx"), (F.col("o_orderkey") % 100).cast("double").alias("y1"),
        F.lit(1.0).alias("zoom"), (3 + F.col("o_orderkey") % 2).cast("int").alias("cols"), (F.col("o_orderstatus") == "P").alias("has_head"), F.lit(10.0).alias("header_y2"),
    )


def order_chains(spark, folder):
    """Chains of tables made of customers' orders."""
    return tables.chains(_chain_input(spark, folder))


def page_chains(spark, folder):
    """Chains of the tables of pages."""
    t = _page_tables(spark, folder)
    h = tables.health(t).select("table_id", "cols")
    head = F.lower("html").contains("<thead")
    heads = layout.entries(table(spark, folder, "page_entries")).where("category = 'Page-Header'").groupBy("doc_id", "page_index").agg(F.max("y2").cast("double").alias("header_y2"))
    return tables.chains(t.withColumn("has_head", head).join(h, "table_id").join(heads, ["doc_id", "page_index"], "left"))


#: Tables written for the repairs, with the grid each must give: (row, column, text, colspan, rowspan).
GOLDEN = {
    "short_span": "<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>",
    "body_columns": "<table><tr><td>h</td><td>i</td></tr><tr><td colspan=2>a</td><td colspan=2>b</td></tr><tr><td colspan=2>c</td><td colspan=2>d</td></tr></table>",
    "label_twice": "<table><tr><th>x</th><th>y</th></tr><tr><td>x</td><td>z</td></tr></table>",
    "long_span": "<table><tr><td>a</td><td rowspan=2>b</td><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>",
    "inset": "<table><tr><td>t</td><td>u</td><td>v</td><td>w</td></tr><tr><td></td><td>n</td><td>1</td><td></td></tr><tr><td></td><td>m</td><td>2</td><td></td></tr></table>",
}
_WANTED = [
    ("short_span", 0, 0, "a", 1, 1), ("short_span", 0, 1, "b", 1, 3), ("short_span", 1, 0, "c", 1, 1), ("short_span", 2, 0, "d", 1, 1),
    *[("body_columns", r, c, t, 2, 1) for r, c, t in ((0, 0, "h"), (0, 2, "i"), (1, 0, "a"), (1, 2, "b"), (2, 0, "c"), (2, 2, "d"))],
    ("label_twice", 0, 0, "x", 1, 2), ("label_twice", 0, 1, "y", 1, 1), ("label_twice", 1, 1, "z", 1, 1),
    ("long_span", 0, 0, "a", 1, 1), ("long_span", 0, 1, "b", 1, 2), ("long_span", 0, 2, "c", 1, 1), ("long_span", 0, 3, "d", 1, 1), ("long_span", 1, 0, "e", 1, 1), ("long_span", 1, 2, "f", 1, 1),
    *[("long_span", 2, c, str(c + 1), 1, 1) for c in range(4)],
    *[("inset", 0, c, t, 1, 1) for c, t in enumerate("tuvw")], ("inset", 1, 0, "", 1, 1), ("inset", 1, 1, "n\n1\nm\n2", 2, 1), ("inset", 1, 3, "", 1, 1),
]


def grid_golden(spark, folder):
    """The grids of tables written for the repairs; golden, not independent."""
    t = spark.createDataFrame(list(GOLDEN.items()), "table_id string, html string")
    return tables.cells(t).select("table_id", "row_no", "col_no", "text", "colspan", "rowspan")


_NAMES = """table_raw_cells table_cells table_health order_table_cells order_table_health run_together_health order_table_weights name_table_weights picture_cells header_groups content_kept reading_better reading_taken span_table_cells span_table_squares
canonical_columns covered_squares order_chains page_chains grid_golden""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
assert G.MOST_COLUMNS == 40

_ROWS = "r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem)"
_CELLS = f"""{_ROWS}, c AS (SELECT CAST(l_orderkey AS VARCHAR) AS table_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR) || '</td><td>' || l_returnflag) - 1 AS INTEGER) AS row_no, unnest([0, 1, 2]) AS col_no,
    unnest([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag]) AS text FROM r)"""
_CHANGED = """lineitem2 AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'Q' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE NOT (l_linenumber = 2 AND l_orderkey % 3 = 0))"""
_CELLS2 = _CELLS.replace("c AS", "c2 AS", 1).replace("r AS", "r2 AS", 1).replace("FROM r)", "FROM r2)").replace("FROM lineitem)", "FROM lineitem2)")
_SPANS = """o AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS r, CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n FROM orders),
    c AS (SELECT CAST(o_custkey AS VARCHAR) AS table_id, r AS row_no, 0 AS col_no, 'c' || o_custkey AS text, 1 AS colspan, n AS rowspan FROM o WHERE r = 0
        UNION ALL SELECT CAST(o_custkey AS VARCHAR), r, unnest([1, 2, 4]), unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR)]), unnest([1, 2, 1]), 1 FROM o)"""
# The tables of pages, cell by cell: their markup is flat and their spans are all one, so a cell's place is its count.
_PAGE_CELLS = r"""t AS (SELECT DISTINCT ON (doc_id, page_index, entry_idx) doc_id || '/' || page_index || '/' || entry_idx AS table_id, text FROM page_entries WHERE contains(lower(text), '<table')),
    r AS (SELECT table_id, CAST(i AS INTEGER) AS row_no, rs[i + 1] AS tr FROM (SELECT table_id, regexp_extract_all(text, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rs FROM t), LATERAL (SELECT unnest(range(len(rs))) AS i)),
    k AS (SELECT table_id, row_no, regexp_extract_all(tr, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) AS cs, regexp_extract_all(tr, '(?i)<t[dh]([^>]*)>', 1) AS tags FROM r),
    c AS (SELECT table_id, row_no, CAST(k AS INTEGER) AS pos, trim(replace(replace(replace(regexp_replace(cs[k + 1], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text,
        coalesce(TRY_CAST(regexp_extract(tags[k + 1], '(?i)colspan="?(\d+)', 1) AS INTEGER), 1) AS colspan, coalesce(TRY_CAST(regexp_extract(tags[k + 1], '(?i)rowspan="?(\d+)', 1) AS INTEGER), 1) AS rowspan FROM k, LATERAL (SELECT unnest(range(len(cs))) AS k))"""
SQL = {
    "order_table_cells": f"WITH {_CELLS} SELECT table_id, row_no, col_no, text FROM c",
    "order_table_health": f"WITH {_ROWS} SELECT CAST(l_orderkey AS VARCHAR) AS table_id, 3 AS cols, CAST(count(*) AS INTEGER) AS n_rows, CAST(count(*) AS INTEGER) AS full_rows, CAST(3 * count(*) AS INTEGER) AS emitted, CAST(3 * count(*) AS INTEGER) AS placed, CAST(3 AS INTEGER) AS widest_row, true AS healthy FROM r GROUP BY l_orderkey",
    "run_together_health": """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS table_id, CAST(2 * count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_suppkey)
        SELECT table_id, least(n, 40) AS cols, 1 AS n_rows, n AS emitted, least(n, 40) AS placed, n AS widest_row, n <= 40 AS healthy FROM s""",
    "order_table_weights": f"WITH {_CELLS} SELECT table_id, col_no, CAST(max(length(text)) AS INTEGER) AS weight FROM c GROUP BY table_id, col_no",
    "name_table_weights": """WITH p AS (SELECT CAST(p_partkey // 50 AS VARCHAR) AS table_id, p_partkey, unnest([0, 1]) AS col_no, unnest([p_name, p_name || ' ' || p_type || ' with ' || p_brand || ' of ' || p_size]) AS t FROM part),
        w AS (SELECT table_id, col_no, length(t) AS w, list_max(list_transform(string_split(t, ' '), lambda x: length(x))) AS word, CASE WHEN length(t) <= 16 THEN ceil(length(t) / 2) ELSE least(22, ceil(length(t) / 16)) END AS strip FROM p)
        SELECT table_id, col_no, CAST(greatest(max(word), max(strip), round_even(quantile_cont(w, 0.75) FILTER (w > 1), 0)) AS INTEGER) AS weight FROM w GROUP BY ALL""",
    "picture_cells": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
        SELECT CAST(l_orderkey AS VARCHAR) AS table_id, CAST(l_linenumber AS INTEGER) AS picture_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row_no, CAST(1 AS INTEGER) AS col_no FROM l""",
    "header_groups": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS table_id, 0 AS col_no, 3 AS width FROM lineitem",
    "content_kept": f"""WITH {_CHANGED}, {_CELLS}, {_CELLS2}, a AS (SELECT table_id, lower(text) AS v, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT table_id, lower(text) AS v, count(*) AS m FROM c2 GROUP BY ALL)
        SELECT table_id, bool_and(m IS NOT NULL AND n - m <= greatest(3, floor(n * 0.25))) AS kept FROM a LEFT JOIN b USING (table_id, v) GROUP BY table_id""",
    "reading_better": f"""WITH {_CHANGED}, {_ROWS}, a AS (SELECT l_orderkey, count(*) AS n FROM r GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS m FROM lineitem2 GROUP BY 1)
        SELECT CAST(l_orderkey AS VARCHAR) AS table_id, m > n AS better FROM a JOIN b USING (l_orderkey)""",
    "reading_taken": "SELECT CAST(l_suppkey AS VARCHAR) AS table_id, CASE WHEN 2 * count(*) > 40 THEN true ELSE count(*) > 1 END AS better FROM lineitem GROUP BY l_suppkey",
    "span_table_cells": f"WITH {_SPANS} SELECT table_id, row_no, col_no, text, colspan, rowspan FROM c",
    "span_table_squares": f"""WITH {_SPANS}, s AS (SELECT table_id, row_no AS cell_row, col_no AS cell_col, unnest(range(row_no, row_no + rowspan)) AS row_no, col_no, colspan FROM c)
        SELECT table_id, cell_row, cell_col, CAST(row_no AS INTEGER) AS row_no, CAST(unnest(range(col_no, col_no + colspan)) AS INTEGER) AS col_no FROM s""",
    "table_raw_cells": f"WITH {_PAGE_CELLS} SELECT table_id, row_no, pos, text, colspan, rowspan, false AS is_header, CAST(0 AS INTEGER) AS images FROM c",
    "table_cells": f"WITH {_PAGE_CELLS} SELECT table_id, row_no, pos AS col_no, text, colspan, rowspan, false AS is_header, CAST(0 AS INTEGER) AS images, false AS nested FROM c",
    "canonical_columns": f"""WITH {_PAGE_CELLS}, n AS (SELECT table_id, count(DISTINCT row_no) AS n FROM c GROUP BY 1) SELECT table_id, pos AS col_no FROM c JOIN n USING (table_id) GROUP BY table_id, pos HAVING count(DISTINCT row_no) = any_value(n)""",
    "covered_squares": f"WITH {_PAGE_CELLS} SELECT table_id, count(*) AS n_squares FROM c GROUP BY table_id",
    "table_health": f"""WITH {_PAGE_CELLS}, w AS (SELECT table_id, row_no, count(*) AS w FROM c GROUP BY ALL), h AS (SELECT table_id, CAST(max(w) AS INTEGER) AS cols, CAST(count(*) AS INTEGER) AS n_rows, CAST(sum(w) AS INTEGER) AS emitted FROM w GROUP BY 1)
        SELECT table_id, cols, n_rows, (SELECT CAST(count(*) AS INTEGER) FROM w WHERE w.table_id = h.table_id AND w.w = h.cols) AS full_rows, emitted, emitted AS placed, cols AS widest_row, false AS degenerate, false AS truncated, false AS missing_columns, true AS healthy FROM h""",
    "order_chains": """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey // 2) AS page_index, o_orderkey AS entry_idx, o_orderkey % 100 AS y1, 3 + o_orderkey % 2 AS cols, o_orderstatus = 'P' AS has_head FROM orders),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY entry_idx) = 1 AS first, lag(cols) OVER (PARTITION BY doc_id ORDER BY page_index, entry_idx) AS before FROM t),
        s AS (SELECT *, CASE WHEN first AND before = cols AND NOT has_head AND y1 - 10 <= 60 THEN 0 ELSE 1 END AS start FROM f),
        n AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY page_index, entry_idx ROWS UNBOUNDED PRECEDING) AS k FROM s)
        SELECT doc_id, table_id, first_value(table_id) OVER (PARTITION BY doc_id, k ORDER BY page_index, entry_idx) AS chain_id FROM n""",
    "grid_golden": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {r}, {c}, {'chr(10)'.join(repr(x) + ' || ' if k < t.count(chr(10)) else repr(x) for k, x in enumerate(t.split(chr(10)))).replace('chr(10)', 'chr(10) || ')}, {w}, {h})" for a, r, c, t, w, h in _WANTED) + ") AS g(table_id, row_no, col_no, text, colspan, rowspan)",
}
