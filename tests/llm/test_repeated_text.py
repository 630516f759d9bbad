import hashlib
import random

from tidewire.llm import repeated_text
from tidewire.llm.repeated_text import remove_repeats


def brute(rows):
    low = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            low[w] = min(low.get(w, 1 << 63), (1 << 62) if d is None else d)
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if low[t[i : i + 50]] < ((1 << 62) if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in remove_repeats(df).collect()), key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [r.choice(passages)[r.randint(0, 20) : r.randint(40, 200)] if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 6))]
        rows.append((d * 7 % 61, " ".join(parts)))
    return rows + [(3, None), (5, ""), (5, rows[5][1]), (None, rows[9][1]), (70, "a" * 300), (71, "a" * 120), (72, "ab" * 100), (73, rows[9][1]), (73, rows[9][1])]


def test_matches_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = texts(seed)
        assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0


def test_anchors_cover_every_window():
    import numpy as np

    for data in (b"a" * 200, bytes(random.Random(1).choices(range(97, 101), k=500)), b"x" * 50):
        at, _ = repeated_text._anchors(np.frombuffer(data, np.uint8))
        assert all(any(i <= p <= i + 30 for p in at.tolist()) for i in range(len(data) - 49))


def test_contents_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    r = random.Random(4)
    made = [bytes(r.choices(b"ab", k=80)) for _ in range(12)]
    rows = np.zeros(60, repeated_text.AROUND)
    for i in range(60):
        rows[i] = i, 0, 30, 30, 30, np.frombuffer(made[r.randrange(12)], np.uint8)
    rows["left"][::7], rows["right"][::5] = 12, 9
    group = np.zeros(60, np.int64)
    want = repeated_text._windows(rows, group)
    assert 0 < len(want) < 60
    # a hash that is one value for all contents
    monkeypatch.setattr(repeated_text, "_powers", lambda n, base: np.zeros(n, np.uint64))
    monkeypatch.setattr(repeated_text, "BASE", 0)
    got = repeated_text._windows(rows, group)
    assert got.tolist() == want.tolist()


def test_very_long_text_repeats_and_clashing_columns(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(60000))
    rows = [(1, long), (2, long[1000:59000] + "é" * 300), (3, "x" * 40 + long[-70:]), (3, "x" * 40 + long[-70:]), (4, " " * 3000), (5, " " * 200), (6, None)]
    df = spark.createDataFrame([(d, t, 1, "s", b"k", 2) for d, t in rows], "doc_id long, text string, n_bytes int, spans string, kept binary, bucket int")
    assert ours(df) == brute(rows)


def test_rows_of_one_id_with_equal_checksums(spark):
    """Two texts of one crc32 under one id, and under none: only what stands in an earlier document goes."""
    import zlib

    r, seen = random.Random(12), {}
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    while True:
        text = "".join(r.choice("abcdefghijklmnop") for _ in range(60))
        text = passage + text if len(seen) % 2 else text
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text and (text.startswith(passage) != other.startswith(passage)):
            break
    rows = [(1, passage), (2, text), (2, other), (None, text), (None, other), (None, other)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
