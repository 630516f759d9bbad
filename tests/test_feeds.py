import json

from tidewire.sources import feeds as S
from tidewire.sources import pages as H

NAMES = "lula|zema|caiado"


def test_envelopes_and_lists_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "v1", "polls": [{"id": "1", "n": 2}, None]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2"}]))
    got = {(r.id, r.n) for r in S.read_envelope(spark, str(tmp_path / "*.json"), "polls", "struct<id:string,n:int>").collect()}
    assert got == {("1", 2), ("2", None)}


def test_written_envelope_counts_its_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "id string, n int")
    assert S.write_envelope(df, str(tmp_path / "e")).first().total_count == 3
    assert spark.read.schema(df.schema).json(str(tmp_path / "e" / "rows")).exceptAll(df).count() == 0


def test_archive_holds_each_row_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    df = spark.createDataFrame([("a", "2026-01"), ("b", "2026-02")], "id string, archive_month string")
    S.write_archive(df.limit(1), path)
    for _ in range(2):
        S.write_archive(df, path, spark.read.schema(df.schema).parquet(path))
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(path).select("id", "archive_month").collect()) == [("a", "2026-01"), ("b", "2026-02")]


def polls(spark, html):
    out = H.extract_polls(spark.createDataFrame([(1, html)], "page_id long, html string"), NAMES).collect()
    return [(r.institute, [(x.candidate, x.pct) for x in r.results]) for r in out]


def test_poll_results_in_json_ld_come_before_the_text(spark):
    data = {"@type": "Dataset", "items": [{"name": "Lula", "percentage": "41,5%"}, {"candidate": "Zema", "value": 7}, {"name": "Lula", "percent": 42}, {"name": "Ninguem", "value": 3}]}
    page = f'<script type="application/ld+json">{json.dumps(data)}</script><article>Pesquisa Quaest: caiado 9%</article>'
    assert polls(spark, page) == [("Quaest", [("zema", 7.0), ("lula", 42.0)])]
    assert polls(spark, page.replace("Dataset", 'broken"')) == [("Quaest", [("caiado", 9.0)])]


def test_poll_results_in_table_rows(spark):
    page = "<article><p>Datafolha</p><table><tr><th>Nome</th><th>Voto</th></tr><tr><td>Lula</td><td>40,5%</td></tr><tr><td>Caiado</td><td>8 %</td></tr></table></article>"
    assert polls(spark, page) == [("Datafolha", [("lula", 40.5), ("caiado", 8.0)])]
    assert polls(spark, "<article>Nada sobre pesquisas</article>") == [] and polls(spark, None) == []
