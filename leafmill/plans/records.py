"""Queries over job, user and session records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import records
from leafmill.sources import table

#: The point in time that listings of sessions are made for.
AS_OF = "2025-03-16 00:00:00"
_ARTIFACTS = {"source": "source_key", "markdown": "markdown_key", "json": "json_key", "docx": "docx_key"}


def _at():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").drop("text", "layout")


def _translations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "translations").drop("text").dropDuplicates(["id"])


def jobs_page(spark, folder):
    """The second page of finished jobs, newest first."""
    return records.page(records.where_all(_jobs(spark, folder), status="ok"), limit=50, offset=50).select("id", "owner_id", "status", "created_at")


def jobs_oldest(spark, folder):
    """The oldest failed jobs."""
    return records.page(records.where_all(_jobs(spark, folder), status="error"), newest=False, limit=20).select("id", "error", "created_at")


def jobs_filtered(spark, folder):
    """All jobs of one status and scan type."""
    return records.where_all(_jobs(spark, folder), status="ok", scan_type="scanned", owner_id=None).select("doc_id", "id", "page_count")


def jobs_counts(spark, folder):
    """Jobs of each owner, and how many are finished, failed and scanned."""
    return records.counted(_jobs(spark, folder), ["owner_id"], n_ok=F.col("status") == "ok", n_error=F.col("status") == "error", n_scanned=F.col("scan_type") == "scanned")


def jobs_elapsed(spark, folder):
    """Jobs and seconds by status."""
    return _jobs(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("elapsed_sec").cast("double").alias("seconds"), F.max("page_count").alias("most_pages"))


def latest_translation(spark, folder):
    """Every job that was translated, with its newest finished translation."""
    done = records.where_all(_translations(spark, folder), status="ok")
    return records.with_latest(_jobs(spark, folder).select("id", "original_name"), done, "id", "source_document_id", {"id": "translation_id", "target_lang": "target_lang", "created_at": "translated_at"}).where("translation_id is not null")


def live_sessions(spark, folder):
    """Sessions alive at a fixed time, with their users."""
    return records.live_sessions(table(spark, folder, "sessions"), table(spark, folder, "users"), _at()).select("session_id", "user_id", "username", "expires_at")


def sessions_kept(spark, folder):
    """Sessions that stay when all but the newest one of each user end."""
    return records.latest_per(table(spark, folder, "sessions").dropDuplicates(["session_id"]), "user_id", "created_at", "session_id").select("session_id", "user_id")


def sessions_expired(spark, folder):
    """Sessions past their end at a fixed time, by user."""
    old = table(spark, folder, "sessions").dropDuplicates(["session_id"]).where(F.col("expires_at") <= _at())
    return old.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_expired"))


def _owned(spark, folder):
    users = table(spark, folder, "users").where("disabled")
    return _jobs(spark, folder).join(users.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")


def delete_survivors(spark, folder):
    """Jobs left when all jobs of disabled users are deleted."""
    return records.without(_jobs(spark, folder), _owned(spark, folder), "id").select("doc_id", "id", "owner_id")


def delete_cascade(spark, folder):
    """Translations left after the same deletion."""
    return records.cascade(_jobs(spark, folder), _translations(spark, folder), _owned(spark, folder), "id", "source_document_id")[1].select("id", "source_document_id")


def translations_orphaned(spark, folder):
    """Translations of a job that isn't there."""
    return records.orphans(_translations(spark, folder), _jobs(spark, folder).where("status = 'ok'"), "source_document_id", "id").select("id", "source_document_id")


def owner_backfill(spark, folder):
    """Jobs by owner once jobs without one are given to a fixed owner."""
    return records.backfilled(_jobs(spark, folder), "owner_id", "unowned").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_jobs"))


def status_patched(spark, folder):
    """Jobs with the states of their newest delivery put in."""
    feed = table(spark, folder, "change_feed").where("tab = 'documents'")
    newest = records.latest_per(feed, "rec_id", "updated_at", "feed_id").select(F.col("rec_id").alias("id"), "status", F.lit("x").alias("owner_id"))
    return records.patched(_jobs(spark, folder), newest, "id", ["status"], _at()).select("id", "status", "owner_id", "updated_at")


def name_clashes(spark, folder):
    """Names of users that are equal but for case."""
    return records.same_name(table(spark, folder, "users"))


def artifact_paths(spark, folder):
    """Path of every artifact of finished jobs."""
    return records.artifacts(records.where_all(_jobs(spark, folder), status="ok"), _ARTIFACTS)


def bundle_manifest(spark, folder):
    """How many artifacts of each kind a bundle of an owner's finished jobs has."""
    jobs = records.where_all(_jobs(spark, folder), status="ok")
    return records.artifacts(jobs, _ARTIFACTS).join(jobs.select("id", "owner_id"), "id").groupBy("owner_id", "kind").agg(F.count(F.lit(1)).alias("n_files"))


def file_kinds(spark, folder):
    """Jobs by the extension of their file."""
    ext = F.lower(F.regexp_extract("original_name", r"(\.[A-Za-z0-9]+)$", 1))
    return _jobs(spark, folder).groupBy(ext.alias("extension"), ext.isin(".pdf", ".docx", ".jpg", ".jpeg", ".png").alias("supported")).agg(F.count(F.lit(1)).alias("n_jobs"))


def id_check(spark, folder):
    """Rows of the feed by whether their record's id is well formed."""
    good = F.col("rec_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return table(spark, folder, "change_feed").groupBy("tab", good.alias("well_formed")).agg(F.count(F.lit(1)).alias("n_rows"))


_NAMES = """jobs_page jobs_oldest jobs_filtered jobs_counts jobs_elapsed latest_translation live_sessions sessions_kept sessions_expired
delete_survivors delete_cascade translations_orphaned owner_backfill status_patched name_clashes artifact_paths bundle_manifest file_kinds id_check""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_T = "t AS (SELECT DISTINCT ON (id) * EXCLUDE (text) FROM translations)"
_S = "s AS (SELECT DISTINCT ON (session_id) * FROM sessions)"
_KINDS = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {c} AS path FROM documents WHERE status = 'ok' AND {c} IS NOT NULL" for k, c in _ARTIFACTS.items())
SQL = {
    "jobs_page": "SELECT id, owner_id, status, created_at FROM documents WHERE status = 'ok' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50",
    "jobs_oldest": "SELECT id, error, created_at FROM documents WHERE status = 'error' ORDER BY created_at, id LIMIT 20",
    "jobs_filtered": "SELECT doc_id, id, page_count FROM documents WHERE status = 'ok' AND scan_type = 'scanned'",
    "jobs_counts": "SELECT owner_id, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (scan_type = 'scanned') AS n_scanned FROM documents GROUP BY owner_id",
    "jobs_elapsed": "SELECT status, count(*) AS n_jobs, CAST(sum(elapsed_sec) AS DOUBLE) AS seconds, max(page_count) AS most_pages FROM documents GROUP BY status",
    "latest_translation": f"""WITH {_T}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY created_at DESC, id) AS k FROM t WHERE status = 'ok' AND source_document_id IS NOT NULL)
        SELECT d.id, d.original_name, r.id AS translation_id, r.target_lang, r.created_at AS translated_at FROM documents d JOIN ranked r ON r.source_document_id = d.id AND k = 1""",
    "live_sessions": f"WITH {_S} SELECT session_id, user_id, username, expires_at FROM s JOIN users u ON u.id = s.user_id WHERE expires_at > TIMESTAMP '{AS_OF}' AND NOT coalesce(u.disabled, false)",
    "sessions_kept": f"WITH {_S} SELECT session_id, user_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id) = 1",
    "sessions_expired": f"WITH {_S} SELECT user_id, count(*) AS n_expired FROM s WHERE expires_at <= TIMESTAMP '{AS_OF}' GROUP BY user_id",
    "delete_survivors": "SELECT doc_id, id, owner_id FROM documents WHERE owner_id IS NULL OR owner_id NOT IN (SELECT id FROM users WHERE disabled)",
    "delete_cascade": f"""WITH {_T}, gone AS (SELECT id FROM documents WHERE owner_id IN (SELECT id FROM users WHERE disabled))
        SELECT id, source_document_id FROM t WHERE source_document_id IS NULL OR source_document_id NOT IN (SELECT id FROM gone)""",
    "translations_orphaned": f"WITH {_T} SELECT id, source_document_id FROM t WHERE source_document_id NOT IN (SELECT id FROM documents WHERE status = 'ok')",
    "owner_backfill": "SELECT coalesce(owner_id, 'unowned') AS owner_id, count(*) AS n_jobs FROM documents GROUP BY 1",
    "status_patched": f"""WITH n AS (SELECT rec_id, status FROM change_feed WHERE tab = 'documents' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY updated_at DESC, feed_id) = 1)
        SELECT d.id, coalesce(n.status, d.status) AS status, d.owner_id, CASE WHEN n.rec_id IS NULL THEN d.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at FROM documents d LEFT JOIN n ON n.rec_id = d.id""",
    "name_clashes": "SELECT lower(username) AS name, count(*) AS n_users, min(id) AS first_id FROM users GROUP BY 1 HAVING count(*) > 1",
    "artifact_paths": _KINDS,
    "bundle_manifest": f"WITH a AS ({_KINDS}) SELECT owner_id, kind, count(*) AS n_files FROM a JOIN documents d USING (id) GROUP BY owner_id, kind",
    "file_kinds": r"""SELECT lower(regexp_extract(original_name, '(\.[A-Za-z0-9]+)$', 1)) AS extension, lower(regexp_extract(original_name, '(\.[A-Za-z0-9]+)$', 1)) IN ('.pdf', '.docx', '.jpg', '.jpeg', '.png') AS supported, count(*) AS n_jobs FROM documents GROUP BY 1, 2""",
    "id_check": "SELECT tab, regexp_matches(rec_id, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS well_formed, count(*) AS n_rows FROM change_feed GROUP BY 1, 2",
}
