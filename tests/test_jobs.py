from pyspark.sql import functions as F

from tidewire.operators import similarity as K
from tidewire.plans import jobs
from tidewire.plans import tables as T

SF = "/root/testdata/sf0.001"
STORY = "Governo anuncia novo plano de metas para a economia do pais"


def planted(spark):
    """A validated, an irrelevant, a raw, a curated and another validated copy of one story, and a row of its own."""
    base = T.articles(spark, SF).limit(1)
    rows = [("a", "validated", "old"), ("b", "irrelevant", "old"), ("c", "raw", None), ("d", "curated", "old"), ("e", "validated", None), ("f", "validated", "old")]
    t = F.lit("2026-01-01 00:00:00").cast("timestamp")
    made = spark.createDataFrame([(i, s, c, "Outro assunto bem diferente hoje" if i == "f" else STORY) for i, s, c in rows], "id string, status string, narrative_cluster_id string, title string")
    rest = base.drop("id", "status", "narrative_cluster_id", "title", "content", "summaries", "published_at", "collected_at", "candidates_mentioned", "topics")
    return made.crossJoin(rest).withColumns({
        "content": F.lit(""), "summaries": F.struct(F.lit("").alias("pt"), F.lit("").alias("en")), "published_at": t, "collected_at": t,
        "candidates_mentioned": F.when(F.col("id") != "e", F.array(F.lit("lula"), F.lit("zema"))).otherwise(F.array().cast("array<string>")), "topics": F.array().cast("array<string>"), "source_category": F.lit("economy"),
    })


def test_narrative_pass_clusters_eligible_rows_only(spark):
    got = {r.id: r for r in jobs.narrative_pass(planted(spark)).collect()}
    name = got["a"].narrative_cluster_id
    assert name.startswith("cluster_") and {k for k, r in got.items() if r.narrative_cluster_id == name} == {"a", "d", "e"}
    assert got["f"].narrative_cluster_id is None and (got["b"].narrative_cluster_id, got["c"].narrative_cluster_id) == ("old", None)
    assert (got["b"].status, got["c"].status, got["d"].status, got["d"].duplicate_of) == ("irrelevant", "raw", "curated", None)
    assert sum(got[k].status == "irrelevant" for k in "ae") >= 1


def test_clean_up_clusters_what_relevance_leaves(spark):
    got = {r.id: r for r in jobs.clean_up(planted(spark)).collect()}
    assert got["e"].demoted and got["e"].status == "irrelevant" and got["e"].duplicate_of is None and not got["a"].demoted
    name = got["a"].narrative_cluster_id
    assert name.startswith("cluster_") and {k for k, r in got.items() if r.narrative_cluster_id == name} == {"a", "c", "d"}
    assert got["b"].narrative_cluster_id == "old" and got["f"].narrative_cluster_id == "old" and got["d"].status == "curated"


def test_narrative_pass_over_all_rows(spark):
    a = T.articles(spark, SF)
    want = {r.id: r.narrative_cluster_id for r in K.clusters(K.cosine_pairs(a.where("status IN ('validated', 'curated')")).select("a", "b")).collect()}
    got = {r.id: r.narrative_cluster_id for r in jobs.narrative_pass(a).where("status IN ('validated', 'curated') OR duplicate_of IS NOT NULL").collect()}
    assert got and got == {k: want.get(k) for k in got} and set(want) <= set(got)
