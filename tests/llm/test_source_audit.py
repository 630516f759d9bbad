import random
import re
from collections import Counter, defaultdict

import pytest

KIND = "doc_id long, text string, lang string, source string, rank int, terms string"


def brute(docs, least, top):
    groups, frequency = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(words)
        frequency[lang or ""].update(set(words))
    kept = {lang: {w for w, n in f.items() if n >= least} for lang, f in frequency.items()}
    whole = defaultdict(Counter)
    for (lang, _), count in groups.items():
        whole[lang].update(count)

    def shares(lang, count):
        v = kept.get(lang, set())
        n = sum(count[w] for w in v)
        return {w: 1 + 1_000_000_000 * (count[w] + 5) // (n + 5 * len(v)) for w in v}

    p, out = {g: shares(g[0], c) for g, c in groups.items()}, set()
    for (lang, source), own in p.items():
        pairs = [(-sum(abs(own[w] - p[lang, s][w]) for w in own), s) for lg, s in groups if lg == lang and s != source]
        q = shares(lang, whole[lang])
        terms = [(-(own[w] - q[w]), w) for w in own if groups[lang, source][w] and own[w] > q[w]]
        for part, rows in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(sorted(rows, key=lambda x: (x[0], x[1].encode())))}
    return out


@pytest.mark.parametrize("models", [1, 3])
def test_audit_matches_brute_force(spark, models):
    from tidewire.llm.source_audit import audit

    r = random.Random(models)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "don't", "日本", "ﬁn", "𝒳y", "A", "zz top"]
    docs = [(" ".join(r.choices(words, range(len(words), 0, -1), k=r.randint(0, 9))), r.choice(["en", "f r", None, ""]), r.choice(["s1", "s2", "s 3", None])) for _ in range(90)]
    docs += [(None, "en", "only nulls"), ("", "alone", "one"), ("rare words here", "few", "s1"), ("", "few", "s2"), ("beta " * 20_000, "en", "s1")] + [("beta beta", "en", "s2")] * 5
    df = spark.createDataFrame([(i, *d, 1, "t") for i, d in enumerate(docs)], KIND).repartition(6)
    got = audit(df, least=4, top=3, models=models).collect()
    assert {tuple(x) for x in got} == brute(docs, 4, 3)
    assert len(got) == len(brute(docs, 4, 3))


def test_audit_of_nothing(spark):
    from tidewire.llm.source_audit import audit

    assert audit(spark.createDataFrame([], KIND)).count() == 0


def test_shares_of_counts_beyond_a_long_times_the_scale(spark):
    from tidewire.llm.source_audit import share

    n, total, v = 10**12 + 1, 3 * 10**12 + 7, 5
    x = spark.createDataFrame([(n, total, v), (0, 0, 0)], "n long, total long, v long").select(share("n").alias("p")).collect()
    assert [r.p for r in x] == [1 + 10**9 * (n + 5) // (total + 5 * v), None]
