import datetime as dt

from pyspark.sql import functions as F

from tidewire.streaming import jobs

SCHEMA = "id string, ordinal int, title string, published_at timestamp, collected_at timestamp"


def test_near_duplicates_across_batches(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    first = [("a", 1, "Governo anuncia novo plano de metas", t, t), ("b", 2, "Outro assunto bem diferente hoje", t, t)]
    second = [("c", 3, "GOVERNO anuncia novo plano de metas", t, t), ("d", 4, "Mais um tema sem semelhança alguma", t, t)]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.near_duplicate_batches(jobs.landed(spark, str(tmp_path / "in"), SCHEMA), out, ck).awaitTermination(200)
        assert spark.read.parquet(out).count() == (2, 3)[k]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "d"]


def test_near_duplicates_of_rows_without_a_time(spark, tmp_path):
    t, late = dt.datetime(2026, 1, 1), dt.datetime(2026, 3, 1)
    first = [("a", 1, "Governo anuncia novo plano de metas", None, None), ("b", 2, "Outro assunto bem diferente hoje", None, late), ("c", 3, "Chuva forte atinge toda a cidade", t, t)]
    second = [("d", 4, "GOVERNO anuncia novo plano de metas", late, late), ("e", 5, "OUTRO assunto bem diferente hoje", late, late)]
    third = [("f", 6, "CHUVA forte atinge toda a cidade", None, None)]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for rows in (first, second, third):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.near_duplicate_batches(jobs.landed(spark, str(tmp_path / "in"), SCHEMA), out, ck).awaitTermination(200)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_daily_mentions(spark, tmp_path):
    rows = [("x", dt.datetime(2026, 1, d, h)) for d in (1, 2, 5) for h in (1, 20)]
    spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.daily_mentions(jobs.landed(spark, str(tmp_path / "in"), "k string, at timestamp"), "k", "at")
    q = stream.writeStream.format("memory").queryName("mentions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {(r.day.day, r.n) for r in spark.table("mentions").collect()}
    assert {(1, 2), (2, 2)} <= got and all(n == 2 for _, n in got)


def test_unique_ids(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1)), ("a", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "id string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = jobs.unique_ids(jobs.landed(spark, str(tmp_path / "in"), "id string, at timestamp"), "id", "at")
    q = stream.select("id", F.lit(1).alias("n")).writeStream.format("memory").queryName("ids").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert sorted(r.id for r in spark.table("ids").collect()) == ["a", "b"]


def test_rolling_feed_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    kind = "id string, score int"
    for rows in ([("a", 5), ("b", 1), ("c", 3)], [("d", 4), ("b", 9)], [("e", 0)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        jobs.rolling_feed(jobs.landed(spark, src, kind), out, ck, [F.desc("score")], n=3).awaitTermination(200)
    feeds = [[(r.id, r.score) for r in spark.read.parquet(f"{out}/{k}").orderBy(F.desc("score")).collect()] for k in range(3)]
    assert feeds == [[("a", 5), ("c", 3), ("b", 1)], [("b", 9), ("a", 5), ("d", 4)], [("b", 9), ("a", 5), ("d", 4)]]


def test_late_rows_are_left_out_once_their_day_is_final(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    kind = "k string, at timestamp"
    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    for rows in ([("x", day(1)), ("x", day(2)), ("x", day(9))], [("x", day(1, 5)), ("x", day(8, 20)), ("x", day(15))], [("x", day(20))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        q = jobs.daily_mentions(jobs.landed(spark, src, kind), "k", "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(200)
    got = sorted((r.day.day, r.n) for r in spark.read.parquet(out).collect())
    # the second row of day 1 came after the watermark had passed its day, that of day 8 in time
    assert got == [(1, 1), (2, 1), (8, 1), (9, 1), (15, 1)]


def test_repeated_batches_add_nothing_and_state_shrinks(spark, tmp_path):
    from tidewire.operators.first_wins import first_wins
    from tidewire.streaming.steps import steps

    t = lambda d, h=0: dt.datetime(2026, 1, d, h)
    batches = [
        [("a", 1, "Governo anuncia novo plano de metas", t(1), t(1)), ("b", 2, "Outro assunto bem diferente hoje", t(1, 5), None)],
        [("c", 3, "Governo anuncia novo plano de metas hoje mesmo", t(2), None), ("a", 4, "Governo anuncia novo plano de metas", t(2), t(2))],
        [("d", 5, "GOVERNO anuncia novo plano de metas", t(4), None), ("e", 6, "Chuva forte atinge a cidade", t(9), None)],
        [("f", 7, "Outro assunto bem diferente hoje", t(2), None), ("g", 8, "Chuva forte atinge a cidade", None, None)],
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([*batches, batches[1], batches[2]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.near_duplicate_batches(jobs.landed(spark, src, SCHEMA), out, str(tmp_path / "ck")).awaitTermination(200)
    jobs.near_duplicate_batches(jobs.landed(spark, src, SCHEMA), out, str(tmp_path / "new")).awaitTermination(200)
    stays = sorted(r.id for r in spark.read.parquet(out).collect())
    gone = {r.id: r.narrative_cluster_id for r in spark.read.parquet(f"{out}.job/duplicates").collect()}
    every = spark.createDataFrame([r for rows in batches for r in rows if r[1] != 4], SCHEMA)
    want = {r.id: r.narrative_cluster_id for r in first_wins(every).collect()}
    assert gone == want and stays == sorted({"a", "b", "c", "d", "e", "f", "g"} - set(want)) and set(want) == {"c", "f", "g"}
    assert [r.n_state for r in steps(spark, f"{out}.job").orderBy("step").limit(4).collect()] == [2, 2, 1, 1]


def test_curated_feed_loses_rows_as_time_passes(spark, tmp_path):
    from tidewire.operators.lifecycle import curated_feed

    kind = "id string, ordinal long, status string, prominence_score double, published_at timestamp, collected_at timestamp"
    t = lambda d, h=0: dt.datetime(2026, 1, d, h)
    batches = [
        [("a", 1, "curated", 0.5, t(1), None), ("b", 2, "validated", 0.9, t(1, 12), None), ("c", 3, "raw", 1.0, t(1, 12), None)],
        [("d", 4, "validated", 0.1, t(2, 6), None), ("b", 5, "irrelevant", 0.9, t(1, 12), None)],
        [(None, 6, "raw", None, t(2, 20), None)],
        [(None, 7, "raw", None, t(9), None)],
    ]
    src, out, got = str(tmp_path / "in"), str(tmp_path / "out"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        jobs.curated_feed_batches(jobs.landed(spark, src, kind), out, str(tmp_path / "ck")).awaitTermination(200)
        got.append([r.id for r in spark.read.parquet(f"{out}/feed/step={k}").orderBy(F.desc(F.col("status") == "curated"), F.desc("prominence_score")).collect()])
    assert got == [["a", "b"], ["d"], ["d"], ["a", "d"]]
    rows = spark.createDataFrame([batches[0][0], *batches[1]], kind)
    assert [r.id for r in curated_feed(rows, F.lit(t(9))).collect()] == ["a", "d"]


def test_late_rows_are_kept_and_merged(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    kind, src, out = "k string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("x", day(1)), ("x", day(2)), ("x", day(9)), ("y", None)], [("x", day(1, 5)), ("x", day(8, 20)), ("y", day(15)), (None, day(15))], [("x", day(20)), ("x", day(9, 3))], [("y", day(2))]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        jobs.counted_days(jobs.landed(spark, src, kind), out, "k", "at", str(tmp_path / "ck")).awaitTermination(200)
    got = {(r.key, r.day.day): (r.n, r.n_late) for r in jobs.corrected_days(spark, out, "k", "at").collect()}
    assert got == {("x", 1): (2, 1), ("x", 2): (1, 0), ("x", 8): (1, 0), ("x", 9): (2, 1), ("x", 20): (1, 0), ("y", 2): (1, 1), ("y", 15): (1, 0)}
    assert spark.read.parquet(f"{out}/late").count() == 5  # the rows without a day as well


def test_mention_trends_equal_the_batch_highlights(spark, tmp_path):
    import random

    from tidewire.operators.aggregates import candidate_highlights

    r = random.Random(5)
    kind, src, out = "candidate string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(r.choice("xxyz"), dt.datetime(2026, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 14))) for _ in range(200)]
    rows = [x for x in sorted(rows, key=lambda x: x[1]) if x[0] != "z" or x[1].day < 5]
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], kind).coalesce(1).write.mode("append").parquet(src)
        jobs.mention_trends(jobs.landed(spark, src, kind), out, "candidate", "at", str(tmp_path / "ck"), late_hours=0).awaitTermination(200)
    got = {(x.key, x.day): (x.n, x.n_recent, x.trend) for x in spark.read.parquet(f"{out}/trends").collect()}
    articles = spark.createDataFrame(rows, kind).select(F.array("candidate").alias("candidates_mentioned"), F.col("at").alias("published_at"), F.col("at").alias("collected_at"), F.lit("curated").alias("status"), F.lit(1.0).alias("prominence_score"), F.lit(0.0).alias("sentiment_score"))
    days, want = sorted({d for _, d in got}), {}
    for d in days:
        end = dt.datetime(d.year, d.month, d.day) + dt.timedelta(days=1)
        want |= {(x.candidate, d): (x.n, x.n_recent, x.trend) for x in candidate_highlights(articles.where(F.col("published_at") < F.lit(end)), F.lit(end)).collect()}
    assert len(days) >= 12 and got == want and {x[2] for x in got.values()} == {"rising", "falling", "stable"}
