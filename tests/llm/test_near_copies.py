import random

import numpy as np

import corpus_pipeline
from tidewire.llm import near_copies as N
from tidewire.llm import simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: grams(t) for k, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def planted():
    r = random.Random(5)
    texts = {}
    for _ in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(40, 400))]
        texts[len(texts)] = " ".join(words)
        for _ in range(r.randint(0, 6)):  # a chain: each copy is of the one before
            words = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 30))):
                words[r.randrange(len(words))] = f"x{r.randrange(3000)}"
            texts[len(texts)] = " ".join(words)
    return texts | {900: "", 901: None, 902: " \n", 903: "one two", 904: "ONE two", 905: "one three"}


def test_classes_match_brute_force(spark):
    texts = planted()
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute(texts)
    assert len(set(want.values())) < len(texts) - 20
    assert got == want


def test_large_groups_match_brute_force(spark, monkeypatch):
    """Groups of over 4 sets, in blocks of 3: chains, so that many sets of a group are not similar to its first."""
    monkeypatch.setattr(N, "GROUP", 4)
    monkeypatch.setattr(N, "BLOCK", 3)
    r = random.Random(8)
    texts = planted()
    for base in range(3):
        words = [f"w{r.randrange(3000)}" for _ in range(200)]
        for k in range(40):
            words = list(words)
            words[r.randrange(200)] = f"x{r.randrange(3000)}"
            texts[1000 + 100 * base + k] = " ".join(words)
    seen = []
    large = N._large
    monkeypatch.setattr(N, "_large", lambda group, least: seen.append(group.select("band").distinct().count()) or large(group, least))
    got = {x.doc_id: x.component_id for x in N.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts)
    assert seen[0] > 3


def test_blocks_lose_no_link(spark, monkeypatch):
    """One group of sets in a ring of overlaps: every similar pair, and no other, is linked in the end."""
    monkeypatch.setattr(N, "BLOCK", 2)
    rows = [(1, k, 23, list(range(k, k + 20))) for k in range(0, 46, 2)]
    group = N.stored(spark.createDataFrame(rows, "band long, fp long, n long, keys array<bigint>"), "group")
    links = {tuple(sorted((x.a, x.b))) for x in N._large(group, 0.8).collect()}
    assert links == {(k, k + 2) for k in range(0, 44, 2)}


def test_stage_keeps_one_of_near_copies(spark):
    texts = planted()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(brute(texts).values()))


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """Where no MinHash band meets, sets whose fingerprints are within three bits are still compared, and only similar ones linked."""
    monkeypatch.setattr(N, "bands", lambda hashes: [int(np.bitwise_xor.reduce(hashes).view(np.int64))])
    r = random.Random(11)
    words = [f"w{r.randrange(3000)}" for _ in range(3000)]
    texts = {1: " ".join(words), 2: " ".join([*words, "last"]), 3: " ".join(f"y{r.randrange(3000)}" for _ in range(3000))}
    sims = [simhash.fingerprint_of(N.shingles(t)) for t in texts.values()]
    assert (sims[0] ^ sims[1]).bit_count() <= 3 < (sims[0] ^ sims[2]).bit_count()
    got = N.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 3} == brute(texts)
