import datetime as dt

from pyspark.sql import functions as F

from leafmill.operators import records

AT = dt.datetime(2025, 1, 2)


def test_filters_and_pages(spark):
    df = spark.createDataFrame([("b", 1, "ok"), ("a", 1, "ok"), ("c", 2, None), ("d", None, "error")], "id string, created_at int, status string")
    assert [r.id for r in records.page(df, limit=3).collect()] == ["c", "a", "b"]
    assert [r.id for r in records.page(df, limit=1, offset=1).collect()] == ["a"]
    assert [r.id for r in records.page(df.where("created_at is not null"), newest=False, limit=2).collect()] == ["a", "b"]
    assert records.where_all(df, status=None).count() == 4
    assert records.where_all(df, status=["ok", "error"]).count() == 3
    assert records.where_all(df, status="ok", id="a").count() == 1


def test_latest_and_lookup(spark):
    kids = spark.createDataFrame([("k1", "p", 1), ("k2", "p", 3), ("k0", "p", 3), ("k9", None, 9)], "id string, parent string, created_at int")
    parents = spark.createDataFrame([("p",), ("q",)], "id string")
    got = records.with_latest(parents, kids, "id", "parent", {"id": "kid"}).collect()
    assert {(r.id, r.kid) for r in got} == {("p", "k0"), ("q", None)}
    assert records.latest_per(kids.where("false"), "parent").count() == 0


def test_sessions_deletes_and_patches(spark):
    users = spark.createDataFrame([("u", "Name", "user", False, False), ("v", "NAME", "user", False, True), ("w", "x", "user", False, None)], "id string, username string, role string, must_change_password boolean, disabled boolean")
    sessions = spark.createDataFrame([("s1", "u", AT), ("s1", "u", AT), ("s2", "v", AT), ("s3", "w", None), ("s4", "w", AT)], "session_id string, user_id string, expires_at timestamp_ntz")
    live = records.live_sessions(sessions, users, F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    assert {r.session_id for r in live.collect()} == {"s1", "s4"} and live.count() == 2
    assert [r.n_users for r in records.same_name(users).collect()] == [2]
    gone = users.where("id = 'u'")
    left, kids = records.cascade(users, sessions, gone, "id", "user_id")
    assert left.count() == 2 and kids.count() == 3
    assert records.orphans(kids, left, "user_id", "id").count() == 0
    changes = spark.createDataFrame([("u", "master", "evil")], "id string, role string, password_hash string")
    new = records.patched(users, changes, "id", ["role"])
    assert {r.id: r.role for r in new.collect()} == {"u": "master", "v": "user", "w": "user"} and new.columns == users.columns
    assert records.patched(users, changes, "id", ["nothing"]) is users
    assert records.backfilled(users, "disabled", False).where("disabled is null").count() == 0


def test_artifacts_and_counts(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", None, None)], "id string, p string, q string")
    assert [(r.id, r.kind, r.path) for r in records.artifacts(df, {"one": "p", "two": "q"}).collect()] == [("a", "one", "x")]
    assert records.counted(df, [], n_p=F.col("p").isNotNull()).first().asDict() == {"n_rows": 2, "n_p": 1}
