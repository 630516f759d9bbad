import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import gates as G
from tidewire.functions import polls as P
from tidewire.functions import scoring as M
from tidewire.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("Eleição  PRÉ-candidato_1", "eleicao pre candidato 1"), ("", ""), ("ﬁm Ünïcode", "m unicode")])
def test_norm_text(spark, text, want):
    assert one(spark, X.norm_text("t"), t=text) == want


def test_norm_text_exact_decomposes_ligatures(spark):
    assert one(spark, X.norm_text_exact("t"), t="ﬁm Ünïcode_x") == "fim unicode x"


def test_ids(spark):
    import hashlib

    assert one(spark, X.short_hash("u"), u="https://a/b") == hashlib.sha256(b"https://a/b").hexdigest()[:16]
    assert one(spark, X.poll_id("i", "d"), i="Quaest", d=dt.datetime(2026, 3, 1)) == hashlib.sha256(b"Quaest_2026-03-01").hexdigest()[:16]


@pytest.mark.parametrize(("text", "want"), [("em 2026-03-01 e 02/03/2025", "2026-03-01"), ("dia 1/12/2025", "2025-12-01"), ("2026-13-01 e 01/02/2026", None), ("nada", None)])
def test_poll_date(spark, text, want):
    got = one(spark, P.poll_date("t"), t=text)
    assert (got and got.isoformat()) == want


def test_poll_numbers(spark):
    t = "Amostra: 2.004 entrevistas, margem de erro de 2,2 p.p., confianca de 95%"
    assert one(spark, P.sample_size("t"), t=t) == 2004
    assert one(spark, P.margin_of_error("t"), t=t) == pytest.approx(2.2)
    assert one(spark, P.confidence_level("t"), t=t) == 95
    assert one(spark, P.coerce_pct("t"), t="100%") == 10
    assert one(spark, P.norm_institute("t"), t=" Genial/Quaest ") == "Quaest"
    assert one(spark, P.poll_candidate("t"), t="bolsonaro") is None


def article(spark, **kw):
    base = {"title": "", "content": "", "source_category": "mainstream", "status": "raw", "topics": [], "candidates_mentioned": [], "pt": "", "en": ""}
    base |= kw
    df = spark.createDataFrame([tuple(base.values())], "title string, content string, source_category string, status string, topics array<string>, candidates_mentioned array<string>, pt string, en string")
    return df.withColumn("summaries", F.struct("pt", "en"))


@pytest.mark.parametrize(
    ("kw", "want"),
    [({"title": " "}, False), ({"title": "Eleição: candidato no segundo turno"}, True), ({"title": "Trump e China", "content": "nasdaq"}, False), ({"title": "Lula viaja"}, True), ({"title": "Lula no futebol", "content": "novela"}, False), ({"title": "Urna", "source_category": "party"}, True), ({"title": "Tempo"}, False)],
)
def test_relevance_gate(spark, kw, want):
    assert G.relevance_gate(article(spark, **kw)).first().gate is want


def test_relevance_score(spark):
    score = lambda **kw: article(spark, **kw).withColumn("relevance_signals", M.relevance_signals()).select(M.relevance_score().alias("x")).first().x
    assert score() == 0.0
    assert 0.5 <= score(candidates_mentioned=["lula", "zema"]) <= 1
    assert score(topics=["economia"]) < 0.3


@pytest.mark.parametrize(("content", "want"), [(None, "empty"), ("T", "equals_title"), ("curto.", "too_short"), ("1 2. " * 40, "no_letters"), ("palavra " * 30, "no_sentence"), ("Access denied. " * 20, "blocked_page"), ("Assine a Folha. Faça seu login. " + "texto " * 30, "paywall"), ("Uma frase boa. " * 20, None)])
def test_integrity(spark, content, want):
    df = spark.createDataFrame([(content, "T")], "c string, t string")
    assert df.select(G.integrity("c", "t").alias("x")).first().x == want


def test_redact_and_snippet(spark):
    assert one(spark, X.redact_secrets("t"), t="a?key=ABCDEFGHIJKLMNOPQRSTUV") == "a?key=[REDACTED]"
    assert one(spark, X.snippet("a", "b", "c"), a="x " * 200, b="", c="").endswith("...")


def test_option_checks(spark):
    good = "Defendo que o governo deve ampliar com prioridade os recursos para escolas, com metas claras e prazos definidos."
    assert one(spark, G.option_failures("a", "b"), a=good, b="ok") == []
    assert set(one(spark, G.option_failures("a", "b"), a="Lula do PT", b="")) == {"length", "first_person", "candidate_reference", "party_reference"}
