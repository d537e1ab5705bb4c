"""Progress events and review decisions, as Structured Streaming and in batch.

``progress(run_id, seq, ts, stage, label, done)``,
``decisions(run_id, finding_id, ts, status, dismiss_reason, note, has_reason, has_note)``.
The same expressions serve both kinds of frames.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.operators.classify import recount

STAGES = ("extract", "detect", "glossary", "align", "checks", "semantic", "classify", "done")
STATUSES = ("unreviewed", "confirmed", "dismissed", "unresolved")
REASONS = ("false_positive", "acceptable_variation", "will_fix_in_source")
PROGRESS = "run_id string, seq bigint, ts timestamp, stage string, label string, done boolean"
DECISIONS = "run_id string, finding_id string, ts timestamp, status string, dismiss_reason string, note string, has_reason boolean, has_note boolean"


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)


def stage_state(events: DataFrame) -> DataFrame:
    """(run_id, reached, finished): an event at a stage means that all before it are done.  Streams in update mode."""
    terminal = (F.col("stage") == "done") & F.col("done")
    return events.groupBy("run_id").agg(F.max(stage_order(F.col("stage"))).alias("reached"), F.max(terminal.cast("int")).alias("finished"), F.max("seq").alias("last_seq"))


def until_terminal(events: DataFrame) -> DataFrame:
    """Events of each run up to its first terminal one, in order (batch): what a replay shows."""
    terminal = ((F.col("stage") == "done") & F.col("done")).cast("int")
    before = F.coalesce(F.sum(terminal).over(W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("_before", before).where("_before = 0").drop("_before")


def with_terminal(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events, and a terminal one for runs that ended without it (``runs(run_id, status)``)."""
    ended = events.where((F.col("stage") == "done") & F.col("done")).select("run_id").distinct()
    last = events.groupBy("run_id").agg(F.max("seq").alias("last"))
    missing = runs.where("status in ('done', 'error')").join(ended, "run_id", "left_anti").join(last, "run_id", "left")
    made = missing.select("run_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.current_timestamp().alias("ts"), F.lit("done").alias("stage"), F.col("status").alias("label"), F.lit(True).alias("done"))
    return events.select(made.columns).unionByName(made)


def running_counts(events: DataFrame) -> DataFrame:
    """``finished_of``: how many events of the run's stage there are up to each one, and ``of``: how many in all (done/total labels)."""
    stage = W.partitionBy("run_id", "stage")
    upto = stage.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumns({"finished_of": F.count(F.lit(1)).over(upto), "of": F.count(F.lit(1)).over(stage)})


def append_progress(events: DataFrame, path: str) -> None:
    """Add events to the table of a run's progress, which streams and replays read."""
    events.select("run_id", "seq", "ts", "stage", "label", "done").write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, sink: Callable[[DataFrame], None], checkpoint: str, runs: set[str], seconds: float = 1.0):
    """(query, ended): hands new events to ``sink`` in order; ``ended`` is set when all ``runs`` have had their terminal event.

    The caller waits for it and stops the query (``until_ended``).
    """
    ended, open_runs = threading.Event(), set(runs)

    def each(batch: DataFrame, _: int) -> None:
        sink(batch.orderBy("run_id", "seq"))
        over = batch.where((F.col("stage") == "done") & F.col("done")).select("run_id").distinct()
        open_runs.difference_update(r.run_id for r in over.where(F.col("run_id").isin(*open_runs)).collect())
        if not open_runs:
            ended.set()

    events = spark.readStream.schema(PROGRESS).parquet(path)
    return events.writeStream.foreachBatch(each).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start(), ended


def until_ended(query, ended: threading.Event, seconds: float | None = None) -> bool:
    """Stop the query when its runs have ended or the time is over; whether they have."""
    try:
        return ended.wait(seconds)
    finally:
        query.stop()


def validated(decisions: DataFrame) -> DataFrame:
    """Decisions with ``error`` (null: accepted), reasons kept for dismissals only and empty notes as null."""
    status, reason = F.col("status"), F.col("dismiss_reason")
    error = (
        F.when(status.isNotNull() & ~status.isin(*STATUSES), "unknown status")
        .when(reason.isNotNull() & ~reason.isin(*REASONS), "unknown reason")
        .when((status == "dismissed") & reason.isNull(), "a dismissal needs a reason")
    )
    return decisions.withColumn("error", error).withColumns({"dismiss_reason": F.when(status == "dismissed", reason), "note": F.nullif(F.trim("note"), F.lit(""))})


def last_decisions(decisions: DataFrame) -> DataFrame:
    """(run_id, finding_id, decision): the last accepted one of each finding; a state of one row a finding in a stream."""
    accepted = validated(decisions).where("error is null")
    return accepted.groupBy("run_id", "finding_id").agg(F.max_by(F.struct("status", "dismiss_reason", "note", "has_note"), F.struct("ts", "status")).alias("decision"))


def applied(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with their last decision."""
    last = last_decisions(decisions).withColumnRenamed("finding_id", "id")
    joined = findings.join(last, ["run_id", "id"], "left")
    changed = F.col("decision").isNotNull()
    values = {
        "status": F.coalesce("decision.status", "status"),
        "dismiss_reason": F.when(changed & F.col("decision.status").isNotNull(), F.col("decision.dismiss_reason")).otherwise(F.col("dismiss_reason")),
        "note": F.when(changed & F.coalesce("decision.has_note", F.lit(False)), F.col("decision.note")).otherwise(F.col("note")),
    }
    return joined.withColumns(values).drop("decision")


def review_stream(decisions: DataFrame, findings: DataFrame, sink: Callable[[DataFrame, DataFrame], None], checkpoint: str, log: str, **trigger):
    """Start a stream that hands the updated findings and counts of each micro-batch's runs to ``sink``.

    All decisions are kept in the folder ``log``, each batch under its number, so
    that one that is repeated after a failure replaces itself.  Of all decisions
    on a finding the latest by time holds, whichever batch brought it.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={n}")
        known = spark.read.schema(f"{DECISIONS}, batch bigint").parquet(log).where(F.col("batch") <= n)
        runs = known.where(F.col("batch") == n).select("run_id").distinct()
        now = applied(findings.join(runs, "run_id", "left_semi"), known.drop("batch").join(runs, "run_id", "left_semi"))
        sink(now, recount(now))

    stream = decisions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def number_of(id_: Column) -> Column:
    """The number at the end of an id, by which ids sort."""
    return F.regexp_extract(id_, r"(\d+)$", 1).try_cast("int")


def next_unreviewed(findings: DataFrame, current: int) -> DataFrame:
    """The next undecided finding of each run after place ``current`` in review order, from the start if there is none."""
    n = F.row_number().over(W.partitionBy("run_id").orderBy(number_of(F.col("id")), "id"))
    total = F.count(F.lit(1)).over(W.partitionBy("run_id"))
    placed = findings.withColumns({"place": n, "of": total}).where("status = 'unreviewed'")
    ahead = F.pmod(F.col("place") - current - 1, F.col("of"))
    return placed.groupBy("run_id").agg(F.min_by("id", ahead).alias("id"))
