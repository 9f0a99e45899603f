from collections import Counter

import pytest

from leafmill import plans
from leafmill.session import cut_lineage

NAMED = {name: (module, query) for module in plans.modules() for name, query in module.QUERIES.items()}
SQL = {name: sql for module in plans.modules() for name, sql in module.SQL.items()}


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def test_names_are_unique_and_sql_has_queries():
    names = [name for module in plans.modules() for name in module.QUERIES]
    assert len(names) == len(set(names)) and set(SQL) <= set(NAMED)


@pytest.mark.parametrize("name", sorted(NAMED))
def test_query(spark, folder, name):
    import duckdb

    df = NAMED[name][1](spark, folder)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in SQL:
        return
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "page_entries", "translations", "change_feed", "runs", "users", "sessions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    given = [c[0] for c in cursor.description]
    assert sorted(given) == columns
    theirs = Counter(tuple(plain(r[given.index(c)]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(NAMED) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_cut_lineage_uses_the_folder_of_the_session(spark):
    assert cut_lineage(spark.range(5)).count() == 5
