import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

KIND = "doc_id long, text string, row long, spans string, term int"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def brute_terms(texts):
    """Spans of the terms of each text that disclose an entity that stands near them."""
    n, near, holds, held = len(texts), [defaultdict(set) for _ in texts], defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        base = brute_base(t)
        words = [m for m in re.finditer(r"[^\W\d_]+", t) if len(m.group()) >= 3]
        for m in words:
            held[m.group().lower()].add(i)
        free = [m for m in words if all(m.end() <= a or m.start() >= b for a, _, b in base)]
        for a, kind, b in base:
            value = t[a:b].lower() if kind == 0 else str([int(p) for p in t[a:b].split(".")]) if kind == 1 else re.sub("[^0-9]", "", t[a:b])
            holds[kind, value].add(i)
            around = [m.group().lower() for m in free if m.start() >= a - 100 and m.end() <= b + 100]
            for w in around:
                if len(near[i][(kind, value), w]) < 2:
                    near[i][(kind, value), w].add(" ".join(around))
    joint = defaultdict(list)
    for i, x in enumerate(near):
        for key, places in x.items():
            joint[key].append((i, places))
    bad = set()
    for (e, w), rows in joint.items():
        if len({frozenset(p) for _, p in rows}) > 1:
            n_te, n_e, n_t = len(rows), len(holds[e]), len(held[w])
            share = 1 + math.log(n_te / n_t) / math.log(n / n_e) if n_e < n else 0
            if share >= 0.75:
                bad.add((e, w))
    out = []
    for i, t in enumerate(texts):
        mine = {w for e, w in near[i] if (e, w) in bad}
        base = brute_base(t)
        out.append([(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in mine and all(m.end() <= a or m.start() >= b for a, _, b in base)])
    return out


def test_base_spans_match_the_plain_patterns():
    from tidewire.llm.private_data import find

    r = random.Random(3)
    for k in range(4000):
        alphabet = ("a1.@-+", "0123456789 -.+()", "25.", "aZ09._%+-@ é", "4 2-")[k % 5]
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert find(t) == brute_base(t), t
    for t in ("4" * 5000, "a" * 300_000 + "@" + "b" * 300_000, "1." * 200_000, "+" + "1 " * 100_000, "0" * 5000 + "1.2.3.4", "4539 5787 6362 1486", "x@y.z@w.v"):
        find(t)
    assert [k for _, k, _ in find("4539 5787 6362 1486")] == [2]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_matches_brute_force(spark, seed):
    from tidewire.llm.private_data import KINDS, report, sanitised

    r = random.Random(seed)
    names = [a + b for a in ("Zbig", "Ottil", "Élo", "Quir") for b in ("niew", "lie", "ïse", "rin", "mund", "ka", "tte", "bert")]
    texts = [None, "", "no data here at all"]
    for i in range(120):
        k = r.randrange(32)
        what = [f"{names[k].lower()}@mail.example.com", f"10.0.0.{k}", "4539 5787 6362 1486", f"+49 (30) 555-01{k:02}"][k % 4]
        common = r.choices("the and with from word more line text some other".split(), k=r.randint(0, 30))
        common.insert(r.randint(0, len(common)), f"{names[k]} {what}" if r.random() < 0.7 else r.choice([what, "plain", names[k]]))
        texts.append(" ".join(common))
    texts += [texts[5]] * 6
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, "s", 2) for i, t in enumerate(texts)], KIND).repartition(5)
    plain = [t or "" for t in texts]
    terms, want = brute_terms(plain), []
    assert any(terms)
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for i, t in enumerate(plain):
        base = brute_base(t)
        want.append((i if i % 9 else None, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(base + terms[i])))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x) for x in report(df).collect()), key=key) == sorted(want, key=key)
    for x in sanitised(df).where("text IS NOT NULL").collect():
        assert not brute_base(x.text) and (x.doc_id is None or all(plain[x.doc_id][a:b] not in x.text.split() for a, _, b in terms[x.doc_id]))


def test_copies_are_no_evidence(spark):
    from tidewire.llm.private_data import disclosing_terms

    t = "Write to Zbigniew at zb@mail.example.com for more"
    df = spark.createDataFrame([(i, t, 1, "", 1) for i in range(50)] + [(99, "other words", 1, "", 1)], KIND)
    assert disclosing_terms(df).count() == 0
    more = df.unionByName(spark.createDataFrame([(100, "Zbigniew again, zb@mail.example.com, elsewhere", 1, "", 1)], KIND))
    assert {x.term for x in disclosing_terms(more).collect()} == {"zbigniew"}


def test_empty_table_and_long_text(spark):
    from tidewire.llm.private_data import report

    df = spark.createDataFrame([], KIND)
    assert report(df).count() == 0
    long = "word " * 300_000 + "a@b.cc " * 2000
    x = report(spark.createDataFrame([(1, long, 1, "", 1)], KIND)).first()
    assert (x.n_email, x.n_ip, x.spans.count(",")) == (2000, 0, 1999)
