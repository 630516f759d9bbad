import hashlib
import random
import re
from collections import Counter

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements(spark):
    from tidewire.llm.quality_rules import ablation, quality_rules

    r = random.Random(1)
    texts = [None, "", " \t\n", "a", "x " * 8, "a b c d e f g h " * 3, "w\n" * 30 + "#", *(" ".join(r.choice("ab cd e# f\n".split(" ")) for _ in range(r.randint(1, 60))) for _ in range(40))]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = quality_rules(df)
    for x in out.collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_rules(x.text)
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert not (x.base_failed and x.kept)
    assert {x.rule: x.n_failed for x in ablation(out).collect()}["few_words"] == sum(brute_rules(t)[0] < 20 for t in texts)
    assert quality_rules(df.limit(0)).count() == 0


def test_pieces_match_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from tidewire.llm.sentence_pieces import encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = [None, "", " ", "  Hello  ▁wor\tld　①é\x00 日本 ", "a" * 900, " " * 700, "</s><unk> <0x0A>", *("".join(r.choice("abcdeth ▁  ing\n日é") for _ in range(r.randint(1, 300))) for _ in range(60))]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z")], "doc_id long, text string, ids string")
    rows = encode_decode(df, path, with_ids=True).collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        ids = lib.encode(texts[x.doc_id] or "", add_eos=True)
        assert x.ids == ids and x.n_tokens == len(ids) and x.decoded == lib.decode(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert encode_decode(df.limit(0), path).count() == 0


def brute_contained(docs, items):
    split = lambda t: "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in (t or "").lower()).split()
    out = set()
    for d, t in docs:
        w = split(t)
        for i, b in items:
            v = split(b)
            k = min(5, len(v))
            g = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            n = len(g & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) if v else 0
            if g and 5 * n >= 4 * len(g):
                out.add((d, i, n, len(g)))
    return out


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_contained_items(spark, monkeypatch, block):
    from tidewire.llm import decontaminate as D

    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(12)] + [(50, None), (51, " .,"), (3, "Same, item!")]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1] or ""
            w = w.split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = word()
            parts += [word() for _ in range(r.randint(0, 20))] + w
        docs.append((d, " ".join(parts).upper()))
    docs += [(90, None), (91, ""), (1, docs[1][1])]
    df, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert {tuple(x) for x in D.contained_items(df, bm).collect()} == want
    clean = D.drop_contaminated(df, bm)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})
    assert D.contained_items(df, bm.limit(0)).count() == 0 and D.contained_items(df.limit(0), bm).count() == 0


def test_classifier_on_the_held_out_fold(spark):
    from tidewire.llm.classifier import classify, fit

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").limit(2500)
    rows = classify(docs, fit(docs, labels, sample=1200)).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= x.score <= 1 for x in rows)
    assert sum(x.predicted == x.quality for x in rows) / len(rows) > 0.95


def test_classifier_edges(spark):
    from tidewire.llm.classifier import classify, fit

    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in classify(docs, fit(docs, none)).collect()] == [0.5] * 4


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    held = {x.doc_id: x.text for x in docs.collect()}
    kept = {x.doc_id for x in C.rules(spark, docs, sf).collect()}
    for d, t in held.items():
        n, chars, symbols, dup, repeats = brute_rules(t)
        lines = sum(bool(x.strip()) for x in t.split("\n"))
        bad = n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or (lines >= 4 and 100 * dup > 50 * lines) or chars > 12 * n or chars < 2 * n
        assert (d in kept) != bad
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = [x.doc_id for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) <= kept and len(got) > 20


def test_sentence_pieces_of_long_words_match_the_library():
    """Words over the limit of symbols, runs, mixed scripts and characters outside the vocabulary, through the same rounds."""
    import random

    import public_tokenizers
    import sentencepiece

    from tidewire.llm.sentence_pieces import PieceModel

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    r = random.Random(3)
    texts = ["the" * 3000, "a" * 5001, " " * 700, "x" + " " * 333 + "y"]
    for alphabet in ("ab", "aA1_-", "éüß漢字日本語 ", "abcdefghijklmnopqrstuvwxyz", "\n\t  x", "😀a"):
        texts += ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 2, 60, 257, 3000)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)


def test_quality_rules_keep_clashing_columns(spark):
    from tidewire.llm.quality_rules import kept_rows, quality_rules

    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 7, "w", "l", 3), (1, text, 7, "w", "l", 3), (2, None, 8, "x", "l", 3)], "doc_id long, text string, n_words long, _words string, _lines string, kept int")
    rows = kept_rows(df).collect()
    assert [(r.doc_id, r.text, r.n_words, r._words, r._lines, r.kept) for r in rows] == [(1, text, 7, "w", "l", 3)] * 2
    assert sorted((r.doc_id, r.n_words, r._words) for r in quality_rules(df).collect()) == [(1, 40, "w"), (1, 40, "w"), (2, 0, "x")]


def test_contained_items_of_every_size(spark):
    """Short items inside one very long text at the edge of 0.8, items of each size partition, repeats and clashing columns."""
    from tidewire.llm import decontaminate as D

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items, parts = [], []
    for n in (1, 4, 5, 6, 8, 9, 14, 19, 20, 36, 67, 131, 260, 600):
        w = [word() for _ in range(n)]
        items.append((n, " ".join(w)))
        windows = max(n - 4, 1)
        # cut off the end, so that exactly the fewest shingles that count are left, and one fewer
        for lost in (windows - -(-4 * windows // 5), windows - -(-4 * windows // 5) + 1):
            parts.append(" ".join(w[: n - lost]))
    items += [(n, t) for n, t in items[:6]] + [(7000 + k, items[7][1]) for k in range(50)]
    filler = [" ".join(word() for _ in range(2000)) for _ in parts]
    docs = [(k, p) for k, p in enumerate(parts)] + [(500, " ".join(f"{f} {p}" for f, p in zip(filler, parts))), (501, None), (502, "")]
    df = spark.createDataFrame([(d, t, "i", "d", 3) for d, t in docs], "doc_id long, text string, item_id string, digest string, n_found int")
    bm = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    want = Counter((d, i, n, g) for i, t in items for d, _, n, g in brute_contained(docs, [(0, t)]))
    assert Counter(tuple(x) for x in D.contained_items(df, bm).collect()) == want and len(want) > 60
    assert D.drop_contaminated(df, bm).columns == df.columns
    assert {x.doc_id for x in D.drop_contaminated(df, bm).collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_contained_items_meet_a_sketch_of_their_partition():
    from tidewire.llm import decontaminate as D

    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((3, 5, 7, 11, 12, 19, 40, 300))]
    index = D._Index([("", t) for t in texts])
    assert len(index.parts) == len({(w, len(g).bit_length()) for w, g in index.grams.values()}) > 4
    for part in index.parts:
        sizes = [len(index.grams[p][1]) for p in set(part.places.tolist())]
        assert max(sizes) < 2 * min(sizes) and all((part.places == p).sum() >= min(n, D._need(n)) for p, n in zip(sorted(set(part.places.tolist())), [len(index.grams[q][1]) for q in sorted(set(part.places.tolist()))]))
