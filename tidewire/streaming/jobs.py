"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.gates import eligible
from tidewire.operators.aggregates import trend
from tidewire.operators.first_wins import first_wins
from tidewire.operators.lifecycle import curated_feed, feed_order, keep_first
from tidewire.session import stored
from tidewire.streaming.steps import Step, held


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def unique_ids(stream: DataFrame, key: str, time: str, late: str = "48 hours") -> DataFrame:
    """First row of each id; state is bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_mentions(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows per key and day, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), key, "n")


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Write rows whose key the target does not hold yet; a repeated batch adds nothing, so reruns are safe."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ARTICLE = "id string, ordinal long, title string, published_at timestamp, collected_at timestamp, status string, narrative_cluster_id string"


def _latest(rows: DataFrame, horizon: object, time: Column) -> object:
    found = rows.agg(F.max(time)).first()[0]
    return found if horizon is None or (found is not None and found > horizon) else horizon


def near_duplicate_batches(stream: DataFrame, target: str, checkpoint: str, window_hours: int = 48) -> StreamingQuery:
    """Near-duplicates at ingest over batches, as ``first_wins`` over all of their rows: ``target`` holds the rows that stay, and
    ``target``.job/duplicates the others, irrelevant and with the cluster of the row that each repeats.

    Rows whose id was taken before are left out, so a repeated batch adds nothing. The others are judged after the rows
    that stay of earlier batches; ordinals rise from batch to batch. The state holds the rows of the last ``window_hours`` before the latest time seen and
    those without a time, which match any; what is older leaves it. Only a batch with a row behind the latest time, or
    without a time, reads stored rows besides.
    """
    at, reach = F.coalesce("published_at", "collected_at"), F.make_dt_interval(hours=F.lit(window_hours))

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        step = Step(spark, f"{target}.job", epoch)
        names = [f.name for f in batch.schema]
        extra = {c: F.lit(None).cast("string") for c in ("status", "narrative_cluster_id", "editor_note") if c not in names}
        batch = batch.withColumns(extra)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        stays = held(spark, target, f"{schema}, step long").where(F.col("step") < step.number)
        taken = stays.select("id").unionByName(step.rows("duplicates", schema).select("id"))
        fresh = stored(keep_first(batch, "id").join(taken, "id", "left_anti").select(*batch.columns), "fresh")
        low, high, timeless, n = fresh.agg(F.min(at), F.max(at), F.count_if(at.isNull()), F.count("*")).first()
        narrow = [F.col(f.split()[0]).cast(f.split()[1]) for f in ARTICLE.split(", ")]
        state = step.state(ARTICLE)
        old = state
        if timeless:
            old = stays.select(*narrow)
        elif low is not None and step.horizon is not None and low < step.horizon:
            old = stays.where(at.isNull() | at.between(F.lit(low) - reach, F.lit(high) + reach)).select(*narrow)
        judged = first_wins(fresh, old, window_hours).where("duplicate").select("ordinal", "id", F.col("narrative_cluster_id").alias("cluster"))
        both = stored(fresh.join(judged.hint("merge"), ["ordinal", "id"], "left"), "both")
        gone = both.where("cluster IS NOT NULL").withColumns({"status": F.lit("irrelevant"), "narrative_cluster_id": F.col("cluster"), "editor_note": F.lit("near-duplicate detected at ingestion")})
        own = both.where("cluster IS NULL")
        step.write("duplicates", gone.select(*batch.columns))
        own.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/step={step.number}")
        horizon = _latest(fresh, step.horizon, at)
        keep = at.isNull() if horizon is None else at.isNull() | (at >= F.lit(horizon) - reach)
        step.end(state.unionByName(own.where("status IS DISTINCT FROM 'irrelevant'").select(*narrow)).where(keep), n, horizon)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_feed(stream: DataFrame, target: str, checkpoint: str, order: list, key: str = "id", n: int = 80) -> StreamingQuery:
    """The first ``n`` rows so far: each batch writes a feed ``target``/epoch of its rows and the feed before it.

    A row of the batch replaces a row of the same key. A repeated batch rewrites its own feed from the one before it, so
    reruns are safe; readers take the highest epoch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            old = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/{epoch - 1}")
            rows = rows.unionByName(old.join(rows.select(key), key, "left_anti"))
        except Exception as e:  # the first batch finds no feed
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{target}/{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def curated_feed_batches(stream: DataFrame, target: str, checkpoint: str, hours: int = 24, n: int = 80, key: str = "id") -> StreamingQuery:
    """The curated feed after each batch, in ``target/feed/step=k``: what ``curated_feed`` gives for all rows so far.

    Now is the latest time seen. The state holds eligible rows of the last ``hours``, which leave it as time passes, and the first
    ``n`` of all, for the feed when none of them is left. A row of a batch replaces a row of the same key; a row without a key
    only tells the time, so that rows leave the feed while no new ones come.
    """
    at = F.coalesce("published_at", "collected_at")

    def write(batch: DataFrame, epoch: int) -> None:
        step = Step(batch.sparkSession, target, epoch)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        batch = stored(batch, "batch")
        now = _latest(batch, step.horizon, at)
        rows = keep_first(batch.where(F.col(key).isNotNull()), key, F.desc("ordinal"))
        old = step.state(schema)
        every = stored(rows.where(eligible()).unionByName(old.join(rows.select(key), key, "left_anti")), "every")
        since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
        best = every.orderBy(*feed_order()).limit(n)
        step.write("feed", curated_feed(every, F.lit(now).cast("timestamp"), hours, n))
        step.end(every.where(at >= since).unionByName(best.where(at.isNull() | (at < since))), batch.count(), now)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _days(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key"), F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


COUNTS = "key string, day date, n long"


def counted_days(stream: DataFrame, target: str, key: str, time: str, checkpoint: str, late_hours: int = 24) -> StreamingQuery:
    """Rows by key and day, and what came late.

    A day is final, and its counts go to ``target/days``, once the latest time of earlier batches is ``late_hours`` past its end;
    until then they are state. Rows of a final day go whole to ``target/late`` instead of being dropped, and
    ``corrected_days`` adds them. Rows without a time or key are late as well: no day is theirs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        step = Step(batch.sparkSession, target, epoch)
        batch = stored(batch.withColumns({key: F.col(key).cast("string")}), "batch")
        closed = lambda day, horizon: F.lit(False) if horizon is None else F.date_add(day, 1).cast("timestamp") <= F.lit(horizon) - F.make_dt_interval(hours=F.lit(late_hours))
        known = F.col(time).isNotNull() & F.col(key).isNotNull()
        behind = ~known | closed(F.to_date(time), step.horizon)
        step.write("late", batch.where(behind))
        open_days = stored(step.state(COUNTS).unionByName(_days(batch.where(~behind), key, time)).groupBy("key", "day").agg(F.sum("n").alias("n")), "open")
        horizon = _latest(batch, step.horizon, F.col(time))
        step.write("days", open_days.where(closed("day", horizon)))
        step.end(open_days.where(~closed("day", horizon)), batch.count(), horizon)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected_days(spark: SparkSession, target: str, key: str, time: str, open_days: bool = True) -> DataFrame:
    """(key, day, n, n_late): final counts with the late rows merged in, and so far open days; as if counted over all rows."""
    step = Step(spark, target, -1)
    parts = [step.rows("days", COUNTS).select("key", "day", "n", F.lit(0).alias("n_late"))]
    if open_days:
        parts.append(step.state(COUNTS).select("key", "day", "n", F.lit(0).alias("n_late")))
    late = step.rows("late", f"`{key}` string, `{time}` timestamp").where(F.col(key).isNotNull() & F.col(time).isNotNull())
    parts.append(_days(late, key, time).select("key", "day", "n", F.col("n").alias("n_late")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("key", "day").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def mention_trends(stream: DataFrame, target: str, key: str, time: str, checkpoint: str, late_hours: int = 24, days: int = 7) -> StreamingQuery:
    """Trend of each key for each day that becomes final, in ``target/trends``: the last day against the ``days`` - 1 before it.

    The state is a ring of day counts by key: a day leaves it when no trend can need it. A key without rows on a day still
    gets its trend, as long as one of the days before has any. Same rule as ``candidate_highlights`` at the end of the day.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        step = Step(spark, target, epoch)
        batch = stored(batch.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumns({key: F.col(key).cast("string")}), "batch")

        def last(time: object) -> date | None:
            """The last day that is final at a time."""
            return None if time is None else spark.range(1).select(F.date_sub(F.to_date(F.lit(time) - F.make_dt_interval(hours=F.lit(late_hours))), 1)).first()[0]

        done, horizon = last(step.horizon), _latest(batch, step.horizon, F.col(time))
        now = last(horizon)
        on_time = batch if done is None else batch.where(F.to_date(time) > F.lit(done))
        ring = stored(step.state(COUNTS).unionByName(_days(on_time, key, time)).groupBy("key", "day").agg(F.sum("n").alias("n")), "ring")
        first = ring.agg(F.min("day")).first()[0]
        start = done + timedelta(days=1) if done is not None else first
        if now is not None and start is not None and start <= now:
            # each count is seen by the ends of the next days; a key and day has one row, so this is days times the ring
            ends = F.sequence(F.greatest(F.col("day"), F.lit(start)), F.least(F.date_add("day", days - 1), F.lit(now)))
            seen = ring.where(F.greatest(F.col("day"), F.lit(start)) <= F.least(F.date_add("day", days - 1), F.lit(now))).select("key", "n", "day", F.explode(ends).alias("end"))
            sums = seen.groupBy("key", "end").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("day") == F.col("end"), F.col("n")).otherwise(0)).alias("n_recent"))
            step.write("trends", sums.select("key", F.col("end").alias("day"), "n", "n_recent", trend("n", "n_recent", days).alias("trend")))
        keep = ring if now is None else ring.where(F.col("day") > F.lit(now - timedelta(days=days - 1)))
        step.end(keep, batch.count(), horizon)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
