import random

from tidewire.llm.line_dedup import drop_repeated_lines, repeated_lines


def brute(rows):
    seen, out = [], {}
    for doc, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            s = frozenset(line.lower().split())
            bad = bool(s) and any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
            if s:
                seen.append(s)
            if not bad:
                kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def test_matches_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 30))] for _ in range(25)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            lines.append(" ".join(w) if r.random() < 0.9 else "")
        rows.append((doc, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in drop_repeated_lines(df).collect()} == brute(rows)


def test_edges_of_the_input(spark):
    rows = [(1, "A b\n\n \nc", 9), (2, "a B\nd", 9), (2, "a B\nd", 9), (None, "d", 9), (3, None, 9), (4, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int")
    got = sorted(((x.doc_id or 99, x.text, x.n_removed) for x in drop_repeated_lines(df).collect()), key=str)
    assert got == sorted([(1, "A b\n\n \nc", 0), (2, "d", 1), (2, "d", 1), (3, None, 0), (4, "", 0), (99, "", 1)], key=str)
    assert repeated_lines(df.limit(0)).count() == 0


def test_frequent_tokens_and_long_lines_match_brute_force(spark, monkeypatch):
    """All tokens frequent: pairs of tokens and classes of lengths are the keys, ids are shuffled, not sent."""
    import tidewire.llm.line_dedup as L

    monkeypatch.setattr(L, "HOT", 1)
    monkeypatch.setattr(L, "LONG", 12)
    monkeypatch.setattr(L, "FEW", 0)
    r = random.Random(9)
    words = [f"w{i}" for i in range(90)]
    base = [[r.choice(words) for _ in range(r.randint(1, 40))] for _ in range(15)]
    rows = []
    for doc in range(50):
        lines = []
        for _ in range(4):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            lines.append(" ".join(w))
        rows.append((doc, "\n".join(lines)))
    rows.append((50, " ".join(f"long{i}" for i in range(5000)) + "\n" + " ".join(f"long{i}" for i in range(500, 5000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in drop_repeated_lines(df).collect()} == brute(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b\na b", 3, 4, 5, 6)], "doc_id long, text string, copy int, doc int, _gone int, n_removed int")
    (row,) = drop_repeated_lines(df).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b", "copy": 3, "doc": 4, "_gone": 5, "n_lines": 2, "n_removed": 1}


def test_rows_of_one_id_that_short_hashes_mix_up(spark):
    """Texts whose hashes agree in 31 bits, without an id and with one id."""
    one, two = "w3946 x3946 y3946", "w339463 x339463 y339463"
    for key in (None, 7):
        df = spark.createDataFrame([(1, two), (key, one), (key, two), (key, one), (key, None), (key, "")], "doc_id long, text string")
        got = sorted((x.doc_id or 99, x.text or "", x.n_removed) for x in drop_repeated_lines(df).collect())
        assert got == sorted([(1, two, 0), (key or 99, one, 0), (key or 99, one, 0), (key or 99, "", 1), (key or 99, "", 0), (key or 99, "", 0)])


def test_ids_that_span_all_numbers(spark):
    """Ids too far apart for numbers less the first are counted in order; a row without one comes last."""
    ids = (-(1 << 63), -5, 3, (1 << 63) - 2, None)
    df = spark.createDataFrame([(i, f"x y\tz\nonly{i} wÉ") for i in ids], "doc_id long, text string")
    got = {x.doc_id: x.text for x in drop_repeated_lines(df).collect()}
    assert got == {i: f"x y\tz\nonly{i} wÉ" if i == ids[0] else f"only{i} wÉ" for i in ids}


def test_keys_are_compiled(spark):
    """No lambda among the expressions that make the keys of the join, which are most of its rows."""
    import tidewire.llm.line_dedup as L

    heads = spark.createDataFrame([(1, 3, 0, 0, True, 2, [5, 6, 7])], "at long, n int, b1 long, b2 long, open boolean, keep int, p array<long>")
    rows = L._rows(heads)
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()
    assert len({x.key for x in rows.collect()}) == 2
