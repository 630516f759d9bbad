import datetime as dt

from pyspark.sql import functions as F

from tidewire.operators import lifecycle as L
from tidewire.operators import quiz as Z
from tidewire.operators.graph import _least, connected_components
from tidewire.operators.similarity import first_wins, title_pairs
from tidewire.session import stored
from tidewire.sources.annotations import parse_annotations
from tidewire.sources.feeds import annotation_batches, read_envelope
from tidewire.sources.pages import link_ladder, main_text


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (7, 3), (8, 10), (3, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 10: 8}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 361 + 1


def test_a_hub_is_split_over_tasks(spark):
    """A star of 100 000 leaves: the join of its edges with the least neighbours is split by adaptive execution."""
    small = {"skewJoin.skewedPartitionThresholdInBytes": "50KB", "skewJoin.skewedPartitionFactor": "1.5", "advisoryPartitionSizeInBytes": "50KB"}
    small = {f"spark.sql.adaptive.{k}": v for k, v in small.items()}
    before = {k: spark.conf.get(k) for k in small}
    star = stored(spark.range(1, 100001, 1, 8).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")), "star")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        joined = star.join(_least(star).hint("merge"), "u")
        assert joined.where("m <> 1").count() == 0
        rows = joined.where("v > m")
        assert len(rows.collect()) == 99999
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
        assert {r.component for r in connected_components(star, "u", "v").select("component").distinct().collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "id string, ordinal int")
    assert sorted(r.ordinal for r in L.keep_first(df).collect()) == [1, 3, 4]


def test_merge_is_idempotent(spark):
    a, b = (spark.createDataFrame(x, "id string, ordinal int") for x in ([("a", 1)], [("a", 2), ("b", 3), ("", 4)]))
    once = L.merge_lists(a, b)
    assert sorted(r.ordinal for r in once.collect()) == [1, 3] == sorted(r.ordinal for r in L.merge_lists(once, b).collect())


def rows(spark, data):
    return spark.createDataFrame([(str(i), i, t, d) for i, t, d in data], "id string, ordinal int, title string, published_at timestamp").withColumn("collected_at", F.col("published_at"))


def day(n):
    return dt.datetime(2026, 1, n)


def test_title_pairs(spark):
    df = rows(spark, [(1, "Governo anuncia novo plano de metas", day(1)), (2, "governo anuncia NOVO plano de metas!", day(1)), (3, "Hoje: governo anuncia novo plano de metas nacional", day(2)), (4, "Governo anuncia novo plano de metas", day(9)), (5, "curto", None), (6, "curto", day(20)), (7, "Outra coisa bem diferente", day(1))])
    got = {(r.pa, r.pb) for r in title_pairs(df).select("pa", "pb").collect()}
    assert got == {(1, 2), (1, 3), (5, 6)} | ({(2, 3)} & got)
    assert (1, 4) not in got


def test_first_kept_row_decides(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "pa int, pb int")
    assert {r.node: r.kept_by for r in first_wins(pairs).collect()} == {2: 1, 4: 3}


def test_affinity(spark):
    a = spark.createDataFrame([("u", "t1", 3.0), ("u", "t2", -3.0)], "user_id string, topic string, weight double")
    o = spark.createDataFrame([("t1", "x", 3, "opt_a"), ("t2", "x", 3, "opt_a"), ("t1", "x", -3, "opt_b"), ("t1", "y", 0, "opt_a")], "topic string, candidate string, weight int, option_id string")
    c = spark.createDataFrame([("x",), ("y",), ("z",)], "candidate string")
    assert {r.candidate: r.affinity for r in Z.affinity(a, o, c).collect()} == {"x": 50.0, "y": 50.0, "z": 0.0}


def test_divergence(spark):
    p = spark.createDataFrame([("a", "x", "confirmed", "strongly_favor"), ("a", "y", "inferred", "strongly_against"), ("b", "x", "confirmed", "favor"), ("b", "y", "unknown", "against")], "topic string, candidate string, position_type string, stance string")
    assert {r.topic: r.divergence for r in Z.divergence(p).collect()} == {"a": 1.0, "b": 0.0}


def test_annotation_repair(spark):
    texts = ['{"k": 1}', '```json\n{"k": 2}\n```', 'so: {"k": 3} end', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    got = {r.i: (r.parsed and r.parsed.k, r.parse_error) for r in parse_annotations(df, "r", "struct<k:int>").collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, False), 3: (None, True), 4: (None, True)}


def test_envelope_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"articles": [{"id": "3"}], "total_count": 1}')
    assert sorted(r.id for r in read_envelope(spark, str(tmp_path), "articles", "struct<id:string>").collect()) == ["1", "2", "3"]


def test_batches(spark):
    df = spark.createDataFrame([(str(i), i, "t", "c" * 700) for i in range(12)], "id string, ordinal int, title string, content string").withColumn("summaries", F.struct(F.lit(None).cast("string").alias("pt")))
    got = annotation_batches(df, 7).collect()
    assert [(r.batch, r.place) for r in sorted(got, key=lambda r: r.ordinal)] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1)] and len(got[0].text) == 600


def test_link_ladder():
    ld = '<script type="application/ld+json">{"@type": "NewsArticle", "url": "/a", "headline": "H"}</script>'
    assert link_ladder("https://x.org/p", ld + '<a href="/news/1">n</a>') == (1, [("https://x.org/a", "H")])
    assert link_ladder("https://x.org/", '<a href="news/1">n</a><a href="/news/1">m</a>')[0] in (0, 3)
    assert link_ladder("https://x.org/", "<h1>T</h1>") == (4, [("https://x.org/", "T")])
    assert link_ladder("", None) == (0, [])


def test_main_text():
    assert main_text("<body><nav>menu</nav><article>" + "palavra " * 20 + "</article></body>") == " ".join(["palavra"] * 20)
    assert main_text("<p>oi</p>") == "oi" and main_text(None) == ""
