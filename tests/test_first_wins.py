import datetime as dt
import hashlib
import random

import pytest

from tidewire.operators.first_wins import Cover, first_wins

KIND = "id string, ordinal long, title string, published_at timestamp, collected_at timestamp, status string, narrative_cluster_id string"
START = dt.datetime(2026, 1, 1)


def norm(t):
    return " ".join((t or "").lower().replace("_", " ").replace("-", " ").split())


def named(a, b):
    return "cluster_" + hashlib.sha256("".join(sorted([a, b])).encode()).hexdigest()[:8]


def brute(rows, hours=48):
    """One row after the other against all earlier ones that stay."""
    stays, out = [], {}
    for x in sorted(rows, key=lambda r: r["ordinal"]):
        if x["status"] == "irrelevant" or not norm(x["title"]):
            continue
        t, words, at, found = norm(x["title"]), set(norm(x["title"]).split()), x["published_at"] or x["collected_at"], None
        for e in stays:
            u, ue, other = norm(e["title"]), set(norm(e["title"]).split()), e["published_at"] or e["collected_at"]
            if at and other and abs(at - other) > dt.timedelta(hours=hours):
                continue
            if t == u or (len(t) > 20 and len(u) > 20 and (t in u or u in t)) or len(words & ue) >= 0.8 * len(words | ue) - 1e-9:
                found = e
                break
        name = None
        if found:
            name = found["narrative_cluster_id"] if (found["narrative_cluster_id"] or "").strip() else named(found["id"], x["id"]) if found["id"] and x["id"] else None
            out[x["ordinal"]] = (found["ordinal"], name)
        if name is None:
            stays.append(x)
    return out


def random_rows(seed, n):
    r = random.Random(seed)
    words = "governo anuncia novo plano de metas para a cidade grande hoje".split()
    for i in range(n):
        k = r.randint(0, len(words) - 1)
        title = r.choice(["", " ".join(words), " ".join(words[k:]), " ".join(words[: k + 1]), " ".join(words[:-1] + ["agora"]), "GOVERNO anuncia-novo plano", "outro assunto", None])
        at = START + dt.timedelta(hours=r.choice([r.randint(0, 400), 48 * r.randint(0, 6), 10]))
        yield {"id": None if r.random() < 0.15 else f"i{i}", "ordinal": i, "title": title, "published_at": None if r.random() < 0.1 else at, "collected_at": None if r.random() < 0.5 else at, "status": r.choice(["raw", "irrelevant", None, "curated"]), "narrative_cluster_id": r.choice([None, None, " ", f"c{i}"])}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_wins_matches_one_after_the_other(spark, seed):
    rows = list(random_rows(seed, 260))
    df = spark.createDataFrame([tuple(x.values()) for x in rows], KIND)
    want = brute(rows)
    assert {r.ordinal: (r.kept_by, r.narrative_cluster_id) for r in first_wins(df.repartition(5)).collect()} == want
    assert any(name is None for _, name in want.values()) and any(name for _, name in want.values())
    old = df.where("ordinal < 100")
    # rows that stay of a first batch, then a second batch: as all in one
    gone = [o for o, (_, name) in want.items() if o < 100 and name]
    both = first_wins(df.where("ordinal >= 100"), old.where(~old["ordinal"].isin(gone)))
    assert {r.ordinal: (r.kept_by, r.narrative_cluster_id) for r in both.collect()} == {o: x for o, x in want.items() if o >= 100}


def test_many_equal_titles_and_none(spark):
    rows = [(f"i{k}", k, "Same title of very many rows", START + dt.timedelta(minutes=k), None, "raw", None) for k in range(20_000)]
    got = first_wins(spark.createDataFrame(rows, KIND))
    want, last = {}, None
    for k in range(20_000):
        if last is None or k - last > 48 * 60:
            last = k
        else:
            want[k] = want.get(k - 1, last) if k - 1 != last and k - want.get(k - 1, last) <= 48 * 60 else last
    assert {r.ordinal: r.kept_by for r in got.collect()} == want
    assert first_wins(spark.createDataFrame([], KIND)).count() == 0


def test_cover_keeps_the_earliest_owner():
    r = random.Random(4)
    for _ in range(300):
        cover, plain = Cover(), []
        for k in range(r.randint(1, 25)):
            at = None if r.random() < 0.05 else r.randint(0, 100)
            cover.add(at, 10, (k,))
            plain.append((at, (k,)))
        for at in [None, *range(-15, 116)]:
            want = next((o for t, o in plain if t is None or at is None or abs(t - at) <= 10), None)
            assert cover.find(at) == want
        assert cover.starts == sorted(cover.starts) and all(a <= b for a, b in zip(cover.starts, cover.ends))
