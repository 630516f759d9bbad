import datetime as dt
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from tidewire.operators import similarity as K

KIND = "id string, title string, content string, summaries struct<pt: string, en: string>, published_at timestamp, collected_at timestamp"
START = dt.datetime(2026, 1, 1)


def rows_of(seed, n):
    r = random.Random(seed)
    words = [f"palavra{i}" for i in range(30)]
    texts = [" ".join(r.choice(words) for _ in range(6)) for _ in range(12)]
    for i in range(n):
        t = r.choice(texts).split()
        if r.random() < 0.4:
            t[r.randrange(6)] = r.choice(words)
        at = None if r.random() < 0.1 else START + dt.timedelta(hours=r.randint(0, 300))
        yield f"n{i:04}", " ".join(t) if r.random() < 0.95 else "", None, None, at, None


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_by_nodes_are_those_of_the_pairs(spark, seed):
    df = spark.createDataFrame(list(rows_of(seed, 160)), KIND).repartition(5)
    groups = lambda out: {r.id: r.narrative_cluster_id for r in out.collect()}
    pairs = groups(K.clusters(K.cosine_pairs(df).select("a", "b")))
    assert groups(K.narrative_clusters(df)) == pairs
    sizes = defaultdict(int)
    for c in pairs.values():
        sizes[c] += 1
    assert len(sizes) > 3 and min(sizes.values()) > 1


def counted(monkeypatch):
    """Rows of every table that is written, by name."""
    seen, plain = defaultdict(int), K.stored

    def stored(df, name="t", **options):
        out = plain(df, name, **options)
        seen[name] = max(seen[name], out.count())
        return out

    monkeypatch.setattr(K, "stored", stored)
    return seen


def test_copies_and_a_hot_term_bring_no_pairs(spark, monkeypatch):
    seen = counted(monkeypatch)
    copies = [(f"c{i}", "Um mesmo texto que volta sempre", None, None, START + dt.timedelta(minutes=20 * i), None) for i in range(2000)]
    other = [(f"h{i}", f"quente unico{i} sozinho{i} raro{i}", None, None, START + dt.timedelta(hours=i % 40), None) for i in range(300)]
    got = K.narrative_clusters(spark.createDataFrame(copies + other, KIND)).collect()
    assert len(got) == 2000 and len({r.narrative_cluster_id for r in got}) == 1
    # the hot term stands in 300 texts of one bucket, the copies are 2000 rows of one class
    assert seen["met"] == 0 and max(n for name, n in seen.items() if name != "tf") <= 3000


def test_clusters_meet_packed_vectors(spark, monkeypatch):
    """A class is one row of vectors, so a candidate pair is one row too, not one for each of its terms."""
    seen = counted(monkeypatch)
    rows = list(rows_of(3, 120))
    assert K.narrative_clusters(spark.createDataFrame(rows, KIND)).count()
    assert 0 < seen["tfidf"] <= len({r[1] for r in rows})


def test_pairs_of_packed_vectors_match_brute_force(spark, monkeypatch):
    seen = counted(monkeypatch)
    rows = list(rows_of(4, 150))
    tf = {}
    for key, title, *_ in rows:
        words = f"{title} {title}".split()
        tf[key] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for terms in tf.values() for t in terms)
    vectors = {}
    for key, terms in tf.items():
        x = {t: n * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, n in terms.items()}
        norm = math.sqrt(sum(w * w for w in x.values()))
        vectors[key] = {t: w / norm for t, w in x.items()}
    at = {r[0]: r[4] for r in rows}
    want = {}
    for a, b in itertools.combinations(sorted(tf), 2):
        cosine = sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
        if cosine >= 0.75 - 1e-12 and (at[a] is None or at[b] is None or abs(at[a] - at[b]) <= dt.timedelta(hours=48)):
            want[a, b] = round(cosine, 9)
    got = {(r.a, r.b): round(r.cosine, 9) for r in K.cosine_pairs(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert len(want) > 100 and got == want
    assert 0 < seen["tfidf"] <= len({r[1] for r in rows})
