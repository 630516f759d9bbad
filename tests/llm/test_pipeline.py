import hashlib
import random

import public_tokenizers
import sentencepiece
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_near
from test_text_operators import brute_contained, brute_rules

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(text):
    n, chars, symbols, dup, repeats = brute_rules(text)
    lines = sum(bool(x.strip()) for x in (text or "").split("\n"))
    return not (n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or (lines >= 4 and 100 * dup > 50 * lines) or chars > 12 * n or chars < 2 * n)


def test_pipeline_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = brute_lines([(d, t) for d, t in texts.items() if brute_kept(t)])
    near = brute_near(texts)
    texts = {d: t for d, t in texts.items() if near[d] == d}
    bad = {d for d, *_ in brute_contained(list(texts.items()), items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for d, t in texts.items():
        if d not in bad:
            ids = library.encode(t, add_eos=True)
            want.add((d, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    got = [tuple(r) for r in C.run(spark, SF).collect()]
    assert len(got) == len(want) > 20 and set(got) == want


def test_stages_on_rows_of_every_kind(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    text, other, long = (" ".join(word() for _ in range(n)) for n in (40, 60, 60000))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 50").first().text
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, text), (4, text), (5, other), (5, long), (None, text), (6, f"{other} {long[:900]} {item} {long[900:2000]}")]
    docs = spark.createDataFrame([(d, t, "en", None, None, 1, 2, 3, 4) for d, t in rows], f"{DOCS}, row int, kept int, doc int, digest int")
    ids = lambda df: sorted((x.doc_id for x in df.collect()), key=str)
    want = {
        "quality_rules": [4, 4, 5, 5, 6, None], "line_dedup": [1, 2, 3, 4, 4, 5, 5, 6, None], "simhash": [1, 4, 5, 5, 6],
        "decontamination": [1, 2, 3, 4, 4, 5, 5, None], "sentence_pieces": [1, 2, 3, 4, 4, 5, 5, 6, None],
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert ids(out) == sorted(want[name], key=str), name
        assert name == "sentence_pieces" or out.columns == list(C.COLUMNS)
        assert stage(spark, docs.limit(0), SF).count() == 0
    left = {(x.doc_id, x.text) for x in C.lines(spark, docs, SF).collect()}
    assert {(1, None), (2, ""), (3, " \n\t"), (4, text), (5, other), (5, long), (None, "")} <= left
