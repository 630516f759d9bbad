"""How often the narrative jobs compute what they read."""

import random

from pyspark.sql import functions as F

from tidewire.operators import lifecycle as L
from tidewire.operators import similarity as K
from tidewire.plans import jobs
from tidewire.plans import tables as T


def counted(spark):
    """Articles of which each reading of a Portuguese summary is counted, and the counter."""
    n = spark.sparkContext.accumulator(0)

    def read(s):
        n.add(1)
        return s

    a = T.articles(spark, "/root/testdata/sf0.001")
    return a.withColumn("summaries", F.struct(F.udf(read, "string")("summaries.pt").alias("pt"), F.col("summaries.en").alias("en"))), n


def test_clean_up_scores_each_row_once(spark):
    rows, n = counted(spark)
    out = jobs.clean_up(rows).select("ordinal", "status", "relevance_score", "duplicate_of").collect()
    assert len(out) > 100 and n.value == len(out)


def test_clusters_read_each_text_once(spark):
    rows, n = counted(spark)
    assert K.narrative_clusters(rows).count()
    assert n.value == rows.count()


def test_decisions_shuffle_no_content(spark):
    rows = T.articles(spark, "/root/testdata/sf0.001")
    out = L.decide_clusters(rows, rows.where("narrative_cluster_id IS NOT NULL").select("id", "narrative_cluster_id")).select("ordinal", "status", "duplicate_of")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.rindex("Join")]
    assert "Join" in joined and "content#" not in joined.replace("length(content#", "")
    assert {r.ordinal for r in out.where("duplicate_of IS NOT NULL").collect()}


def test_few_pairs_meet_whole_vectors(spark, monkeypatch):
    """Of the pairs that meet at a term, sketches leave little more than the similar ones."""
    seen, plain = {}, K.stored

    def stored(df, name="t", **options):
        out = plain(df, name, **options)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(K, "stored", stored)
    kind = "id string, title string, content string, summaries struct<pt: string, en: string>, published_at timestamp, collected_at timestamp"
    r = random.Random(1)
    words = [f"p{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(14)] for _ in range(8)]
    rows = []
    for k in range(160):
        t = list(r.choice(base))
        for _ in range(r.randrange(7)):
            t[r.randrange(14)] = r.choice(words)
        rows.append((f"n{k:03}", " ".join(t), None, None, None, None))
    assert K.cosine_pairs(spark.createDataFrame(rows, kind).repartition(3)).count()
    similar = seen["similar"] - seen["tfidf"]  # each class is similar to itself
    assert 0 < similar <= seen["likely"] <= 1.2 * similar and 2 * seen["likely"] < seen["met"]


def test_an_empty_table_has_no_pairs(spark):
    rows = T.articles(spark, "/root/testdata/sf0.001").where("ordinal < 0")
    assert K.cosine_pairs(rows).count() == 0 and K.narrative_clusters(rows).count() == 0
