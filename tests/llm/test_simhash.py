import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from tidewire.llm import simhash


def brute_fp(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_fingerprint_matches_brute_force():
    r = random.Random(3)
    for text in ["", None, " \n", "One", "a b", "a b c", "É A b", *(" ".join(r.choice("ab cd ef Gh i".split()) for _ in range(r.randint(1, 200))) for _ in range(40))]:
        assert simhash.fingerprint(text) == brute_fp(text)


def link_fps(spark, fps, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    df = spark.createDataFrame([Row(doc_id=i, fp=int(np.uint64(f).astype(np.int64))) for i, f in fps.items()], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: df.withColumnRenamed("doc_id", "key"))
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}


@pytest.mark.parametrize("small", [4096, 3])
def test_links_match_brute_force(spark, monkeypatch, small):
    r = random.Random(small)
    fps = {}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(20):
            fps[len(fps)] = x
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                x ^= 1 << r.randrange(64)
    fps[len(fps)] = 0
    fps[len(fps)] = (1 << 64) - 1
    assert link_fps(spark, fps, monkeypatch, small) == brute_components(fps)


def test_wide_group_matches_pairs():
    r = random.Random(5)
    base, varying = r.getrandbits(64), [40, 13, *range(16, 32)]
    fps = np.array(sorted({base ^ sum(1 << b for b in varying if r.random() < 0.3) for _ in range(900)}), np.uint64)
    count = lambda got: len(fps) - sum(map(len, got[0]))  # noqa: E731  number of classes
    a, b = simhash._forest_wide(fps, varying)
    assert all((np.bitwise_count(x ^ y) <= 3).all() for x, y in zip(a, b, strict=True))
    assert count((a, b)) == count(simhash._forest(fps))


def test_edges_of_the_input(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "y"), (None, "a b c d", "z"), (2, None, None), (9, "", None), (7, "q w e r t y u", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 5), (2, 2), (5, 5), (5, 5), (7, 7), (9, 2)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 5, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
