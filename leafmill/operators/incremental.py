"""Only new and changed records, each exactly once, over runs that may fail.

Deliveries of a record come in the order ``arrived_at, feed_id``. A delivery
is a change if it is the record's first, if its ``updated_at`` is later than
every earlier one's, or if it equals the latest and its status differs from
that of the last change. A change's key is (tab, rec_id) and its version the
delivery's ``feed_id``.

A run selects by ``updated_at``: of the deliveries that have arrived by its
start it reads those later than the last successful run's start. That alone
would lose each transaction still open at that run, whose ``updated_at`` lies
at or before the run's start but whose delivery arrived after it; so a run
rereads from the oldest of them on. The overlap that this rereads is removed by
an anti-join of key and version against the ledger of what earlier runs
processed. A replay of a whole history does the same for all runs at once: a
ledger row carries its run, and a run meets the rows of earlier runs only. A failed or unfinished run writes no ledger rows, so its records
fall to the next successful run.

Defined results: a null ``updated_at`` counts as before all others, and is
read by its arrival; null status is a status of its own; deliveries without ``arrived_at`` or record are
never covered; repeated deliveries with one ``feed_id`` count once in the
result; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tab", "rec_id"]
LEDGER = [*KEY, "version"]


def changes(feed: DataFrame, chunk: str = "day") -> DataFrame:
    """tab, rec_id, version, status, updated_at, arrived_at of each change in the feed.

    The state before a delivery is the greatest (updated_at, arrived_at,
    feed_id, status) of the record so far: its first field is the latest
    ``updated_at``, its last the status last seen at that time. A running
    maximum splits into chunks: one within (record, ``chunk`` of arrival) and
    one over the chunks' maxima, which a partial aggregation prepares. So no
    task holds more of a record than one chunk's deliveries.
    """
    rows = feed.select(
        "tab", "rec_id", "feed_id", "status", "arrived_at",
        "updated_at", F.date_trunc(chunk, "arrived_at").alias("chunk"),
        F.struct(
            F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63))).alias("u"),
            F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("a"),
            F.col("feed_id").alias("f"), F.col("status").alias("s"),
        ).alias("state"),
    ).where("arrived_at is not null and rec_id is not null and tab is not null")
    before = Window.unboundedPreceding, -1
    heads = (
        rows.groupBy(*KEY, "chunk").agg(F.max("state").alias("head"))
        .withColumn("state", F.max("head").over(Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(*before)))
        .where("state is not null").select(*KEY, "chunk", "state")
    )
    # A chunk's carried state goes before its deliveries, as their first row.
    inside = Window.partitionBy(*KEY, "chunk").orderBy(F.col("arrived_at").asc_nulls_first(), "feed_id").rowsBetween(*before)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn("last", F.max("state").over(inside))
        .where("arrived_at is not null")
        .where("last is null or state.u > last.u or (state.u = last.u and not (state.s <=> last.s))")
        .select("tab", "rec_id", F.col("feed_id").alias("version"), "status", "updated_at", "arrived_at")
    )


def reread_spans(feed: DataFrame, runs: DataFrame, longest_list: int = 100_000) -> DataFrame:
    """run_id, ordinal, low, high: each successful run reads what has arrived by ``high`` and has an ``updated_at`` of ``low`` or later.

    ``high`` is the run's start. ``low`` never falls from run to run. It is the earliest begin of a transaction
    open at the previous successful run: the least ``updated_at`` at or before
    that run's start among deliveries that arrived after it, or the start
    itself if none was open. The runs are one row per execution of a schedule;
    more than ``longest_list`` of them are refused rather than broadcast.
    """
    ok = runs.where("state = 'ok' and started_at is not null").select("run_id", F.col("started_at").alias("high"))
    starts = sorted((r.high, r.run_id) for r in ok.limit(longest_list + 1).collect())
    if len(starts) > longest_list:
        raise ValueError(f"more than {longest_list} successful runs: compact the list of runs first")
    spark = runs.sparkSession
    table = spark.createDataFrame(
        [(run_id, k, starts[k - 1][0] if k else None, high) for k, (high, run_id) in enumerate(starts)],
        "run_id long, ordinal int, previous timestamp_ntz, high timestamp_ntz",
    )
    # An open transaction spans (updated_at, arrived_at]: by day, so that a delivery meets only the runs of its days.
    late = feed.select(F.col("updated_at").cast("timestamp_ntz").alias("u"), F.col("arrived_at").cast("timestamp_ntz").alias("a")).where("u < a")
    days = F.sequence(F.to_date("u"), F.to_date("a"))
    opened = (
        late.withColumn("day", F.explode(days))
        .join(F.broadcast(table.where("previous is not null").withColumn("day", F.to_date("previous"))), "day")
        .where("u <= previous and previous < a")
        .groupBy("ordinal").agg(F.min("u").alias("oldest"))
    )
    return table.join(F.broadcast(opened), "ordinal", "left").select(
        "run_id", "ordinal", F.coalesce("oldest", "previous").alias("low"), "high"
    )


def readers(spans: DataFrame) -> list[tuple]:
    """after, upto, first, again, last for each stretch of time in (after, upto]: the run that reads it anew, and the first and last run that read it again.

    Of ``updated_at`` a run reads (start of the run before, own start] anew and
    [low, start of the run before] again. As ``low`` never falls, all runs from
    ``again`` to ``last`` read the stretch. The earliest stretch has no
    ``after`` and is not read again. Of an arrival, ``first`` is the first run
    that finds it.
    """
    tick = dt.timedelta(microseconds=1)
    rows = sorted((r.ordinal, None if r.low is None else r.low - tick, r.high) for r in spans.collect())
    ends = sorted({h for _, _, h in rows} | {low for _, low, _ in rows if low is not None and low < rows[-1][2]})
    waiting = sorted(((low, k) for k, low, _ in rows if low is not None), reverse=True)
    before = {k: h for (k, _, _), (_, _, h) in zip(rows[1:], rows)}
    active: list[int] = []
    out, fresh, last, after = [], 0, 0, None
    for upto in ends:
        while after is not None and waiting and waiting[-1][0] <= after:
            k = waiting.pop()[1]
            heapq.heappush(active, k)
            last = max(last, k)
        while active and before[active[0]] < upto:
            heapq.heappop(active)
        while rows[fresh][2] < upto:
            fresh += 1
        out.append((after, upto, rows[fresh][0], active[0] if active else None, last if active else None))
        after = upto
    return out


def candidates(changed: DataFrame, spans: DataFrame) -> DataFrame:
    """ordinal, fresh and change for each change and the first run that reads it anew (``fresh``), and the first that reads it again; the ledger's pairs are not yet removed.

    A change that arrived late is read again only, by the run that first finds
    it; any other is read anew, and again while a transaction is open. Further
    runs that read it the same way meet the ledger row of the first, so a
    change has at most two candidates, however long a transaction was open.

    Stretches are cut by day, so the joins are on the day with a residual
    range; what lies in the earliest stretch meets its one run by a condition.
    """
    stretches = readers(spans)  # at most two for each run
    if not stretches:
        return changed.where("false").select(F.lit(0).alias("ordinal"), F.lit(True).alias("fresh"), *changed.columns)
    _, earliest, oldest, _, _ = stretches[0]
    table = changed.sparkSession.createDataFrame(stretches[1:], "after timestamp_ntz, upto timestamp_ntz, first int, again int, last int")
    table = table.withColumn("day", F.explode(F.sequence(F.to_date("after"), F.to_date("upto"))))
    rows = changed.withColumn("at", F.col("arrived_at").cast("timestamp_ntz")).withColumn("begun", _begun())

    def met(rows: DataFrame, time: str) -> DataFrame:
        cut = F.broadcast(table.select(*(F.col(c).alias(f"{time}_{c}") for c in table.columns)))
        here = (F.to_date(time) == F.col(f"{time}_day")) & (F.col(time) > F.col(f"{time}_after")) & (F.col(time) <= F.col(f"{time}_upto"))
        first = F.when(F.col(time) <= F.lit(earliest).cast("timestamp_ntz"), F.lit(oldest)).otherwise(F.col(f"{time}_first"))
        return rows.join(cut, here, "left").withColumn(f"{time}_first", first)

    found, again = F.col("at_first"), F.greatest("at_first", "begun_again")
    anew = F.coalesce("begun_first", F.lit(stretches[-1][2]))  # later than all runs: new to each of them
    read = F.array(
        F.struct(F.when(found <= anew, found).alias("ordinal"), F.lit(True).alias("fresh")),
        F.struct(F.when(again <= F.col("begun_last"), again).alias("ordinal"), F.lit(False).alias("fresh")),
    )
    return (
        met(met(rows, "at").where("at_first is not null"), "begun")
        .withColumn("read", F.explode(read)).select("read.*", *changed.columns).where("ordinal is not null")
    )


def _begun() -> Column:
    """The time by which a run selects a delivery."""
    return F.coalesce("updated_at", "arrived_at").cast("timestamp_ntz")


def unprocessed(read: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``read`` whose key and version are not in ``ledger``, each key and version once; where both have ``ordinal``, not in the ledger of an earlier run."""
    if "ordinal" not in read.columns:
        return read.join(ledger.select(*LEDGER), LEDGER, "left_anti").dropDuplicates(LEDGER)
    done = ledger.select(*(F.col(c).alias(f"done_{c}") for c in (*LEDGER, "ordinal")))
    same = [F.col(c) == F.col(f"done_{c}") for c in LEDGER]
    return read.join(done, [*same, F.col("done_ordinal") < F.col("ordinal")], "left_anti").dropDuplicates([*LEDGER, "ordinal"])


def replay(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, tab, rec_id: what each successful run of a history covers, one row for each run and record.

    All runs at once: every run reads its candidates and anti-joins them with
    the ledger's rows of earlier runs, which are what those read.
    """
    spans = reread_spans(feed, runs)
    read = candidates(changes(feed), spans).select(*LEDGER, "ordinal")
    owner = unprocessed(read, read).select("ordinal", *KEY).distinct()
    return owner.join(F.broadcast(spans.select("ordinal", "run_id")), "ordinal").select("run_id", *KEY)


def next_batch(feed: DataFrame, runs: DataFrame, ledger: DataFrame, run_id: int) -> DataFrame:
    """The changes that run ``run_id`` has to process, given the ledger of processed key-version pairs.

    The caller writes the batch's LEDGER columns together with its output; if
    the run fails before that, the ledger is unchanged and the next run gets
    the same rows.
    """
    upto = runs.where((F.col("state") == "ok") | (F.col("run_id") == run_id)).withColumn("state", F.lit("ok"))
    changed = changes(feed)
    span = reread_spans(feed, upto).where(F.col("run_id") == run_id).first()
    if span is None:
        return unprocessed(changed.where("false"), ledger)
    at = F.col("arrived_at").cast("timestamp_ntz")
    read = at <= F.lit(span.high).cast("timestamp_ntz")
    if span.low is not None:
        read &= _begun() >= F.lit(span.low).cast("timestamp_ntz")
    return unprocessed(changed.where(read), ledger)
