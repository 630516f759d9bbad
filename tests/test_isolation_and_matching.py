import gzip
import json
import os
import random


from tidewire.functions import gates as G
from tidewire.operators.matching import containing, fits
from tidewire.operators.similarity import cluster_names
from tidewire.sources import feeds as S
from tidewire.sources.isolation import isolate, read_files


def test_a_broken_source_costs_one_error(spark, tmp_path):
    def put(source, name, data):
        folder = tmp_path / "in" / f"source={source}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)

    doc = lambda *ids: json.dumps({"articles": [{"id": i, "n": k} for k, i in enumerate(ids)]}).encode()
    put("good", "a.json", doc("a", "b"))
    put("good", "b.json.gz", gzip.compress(doc("c", None, " ")))
    put("list", "a.json", json.dumps([{"id": "d"}, "text", None, 3]).encode())
    put("cut", "a.json", doc("e", "f")[:-4])
    put("torn", "a.json.gz", gzip.compress(doc(*map(str, range(500))))[:-30])
    put("binary", "a.json", b"\xff\xfe\x00\x81")
    put("shape", "a.json", b'{"articles": {"id": "g"}}')
    put("empty", "a.json", b"")  # Spark lists no file without content
    rows, bad, ledger = isolate(read_files(spark, str(tmp_path / "in")), "articles", "struct<id: string, n: int>")
    assert sorted((r.source, r.id) for r in rows.collect()) == [("good", "a"), ("good", "b"), ("good", "c"), ("list", "d")]
    assert {r.source: (r.n_files, r.n_errors, r.n_rows, r.n_bad_records) for r in ledger.collect()} == {"good": (2, 0, 3, 2), "list": (1, 0, 1, 3), "cut": (1, 1, 0, 0), "torn": (1, 1, 0, 0), "binary": (1, 1, 0, 0), "shape": (1, 1, 0, 0)}
    assert {(r.source, r.why) for r in bad.collect()} == {("good", "no id"), ("list", "not an object"), ("cut", "not JSON"), ("torn", "not readable"), ("binary", "not UTF-8"), ("shape", "no list of items")}


def test_containing_matches_every_text_with_every_pattern(spark):
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    texts = [letters(r.randint(0, 40)) for _ in range(300)] + [None, "", "abcabcabcabc" * 50]
    patterns = [letters(r.randint(1, 12)) for _ in range(25)] + ["", None, "abcabcabca", "zzzzzzzzzz"]
    t, p = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in patterns], "value string")
    want = {x for x in texts if x is not None and any(y in x for y in patterns if y)}
    for gram in (1, 3, 8):
        assert {x.text for x in containing(t, p, gram=gram).collect()} == want
    assert containing(t, p.limit(0)).count() == 0
    assert fits(p) and not fits(p, rows=5) and not fits(p, chars=20)


def test_block_rules_are_the_same_by_array_and_by_index(spark, monkeypatch):
    from tidewire.operators import matching

    r = random.Random(7)
    rows = [(f"i{k}", f"https://{r.choice('abc')}.example.org/{k % 7}", r.choice(["Um título curto", "Outro-assunto", None, "Notícia grande"]), r.choice(["A", "b", None]), 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, url string, title string, source string, extra int")
    rules = [("irrelevant_article_ids", "i3"), ("blocked_sources", "B"), ("blocked_url_substrings", "A.example.org/2"), ("blocked_url_substrings", "/5"), ("blocked_title_keywords", "titulo-CURTO"), ("blocked_title_keywords", "")]
    rules = spark.createDataFrame(rules, "rule_kind string, value string")
    small = sorted(map(tuple, G.block_reasons(df, rules).collect()), key=str)
    monkeypatch.setattr(matching, "fits", lambda p: False)
    assert sorted(map(tuple, G.block_reasons(df, rules).collect()), key=str) == small
    assert {x[-1] for x in small} == {"id", "source", "url", "title", None}


def test_second_write_of_the_same_rows_changes_no_file(spark, tmp_path):
    path = str(tmp_path / "e")
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, {}), (2, None, {})], "id int, t string, m map<string, int>")
    first = S.write_envelope(df, path).first()
    before = files()
    assert S.write_envelope(df.repartition(3).select("m", "t", "id"), path).first() == first and files() == before
    assert S.write_envelope(df.limit(2), path).first() != first and files() != before
    assert spark.read.json(f"{path}/rows").count() == 2
    S.write_envelope(df.where("id = 2"), path)
    assert spark.read.json(f"{path}/rows").count() == 2  # two equal rows are not the two rows before


def test_missing_envelope_is_an_empty_table_where_asked_for(spark, tmp_path):
    assert S.read_envelope(spark, str(tmp_path / "none.json"), "polls", "struct<id:string>", missing_ok=True).count() == 0


def test_cluster_names_hash_sorted_members(spark):
    import hashlib

    rows = [(f"n{i}", f"n{i % 5}") for i in range(500)]
    got = {r.component: r.narrative_cluster_id for r in cluster_names(spark.createDataFrame(rows, "node string, component string").repartition(7)).collect()}
    for c in range(5):
        members = sorted(n for n, k in rows if k == f"n{c}")
        assert got[f"n{c}"] == "cluster_" + hashlib.sha256("".join(members).encode()).hexdigest()[:8]


def test_grams_that_no_pattern_has_are_not_shuffled(spark):
    from tidewire.operators import matching

    t = spark.createDataFrame([(f"texto numero {k} sem nada {k * 7919}",) for k in range(300)] + [("aqui vai o alvo",)], "text string")
    p = spark.createDataFrame([("alvo",), ("ausente",), ("muito comprido",)], "value string")
    keys = spark.createDataFrame([("alvo",), ("ausente",)], "key string")
    bits = matching._possible(keys).first().bits
    assert len(bits) == matching.BITS // 64 and sum((b & (1 << 64) - 1).bit_count() for b in bits) == 2
    assert [x.text for x in containing(t, p).collect()] == ["aqui vai o alvo"]
