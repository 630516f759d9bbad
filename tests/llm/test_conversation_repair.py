import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

KIND = "conv_id long, turn long, role string, text string, kind int, place string, block int"
END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if harm == 4:
            role = "user"
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def brute_audit(rows):
    """The cheapest letters by trying every edit, and what they leave."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "none" if END.search(text) else "truncated")
        seen.add((role, text))

    def steps(state, initial):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserts=0):
        ways = []
        if i == len(rows):
            if state in "0a":
                ways.append((0, "", ()))
        else:
            role, text = rows[i][2], rows[i][3]
            more = 3 * (faults[i] == "truncated")
            c, t, r = best(i + 1, state)
            ways.append((4 + c, "D" + t, r))
            if faults[i] not in ("blank", "duplicate"):
                if to := steps(state, role[:1]):
                    c, t, r = best(i + 1, to)
                    ways.append((more + c, "K" + t, (f"{role}:{text}", *r)))
                for new in ("user", "assistant"):
                    if to := steps(state, new[0]):
                        c, t, r = best(i + 1, to)
                        ways.append((3 + more + c, "R" + t, (f"{new}:{text}", *r)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if to := steps(state, new[0]):
                    c, t, r = best(i, to, inserts + 1)
                    ways.append((3 + c, "I" + t, (f"{new}:", *r)))
        return min(ways) if ways else (10**9, "", ())

    cost, letters, left = best(0, "0")
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(left).encode()).hexdigest()


def rows_of(r, n):
    out = []
    for conv in [None, *range(n)]:
        for turn in range(r.choice((0, 1, 2, 5, 9, 14))):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Hi there.", "And so on", "", " \t", None, f"Text {r.randint(0, 99)}!", f"Text {r.randint(0, 99)}"])
            out.append((conv, r.choice([turn, turn, turn + 3, None]), role, text))
    return out


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_audit_matches_brute_force(spark, bits):
    from tidewire.llm.conversation_repair import audit, damage

    rows = rows_of(random.Random(bits), 60)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(7)
    out = audit(damage(df), bits).collect()
    assert len(out) == len({r[0] for r in rows})
    left = brute_damage(rows)
    for x in out:
        assert tuple(x)[1:] == brute_audit([r for r in left if r[0] == x.conv_id]), x


def test_long_conversation_of_rows_that_do_not_converge(spark):
    from tidewire.llm.conversation_repair import as_given, audit, repaired

    rows = [(1, i, "user", f"No end {i}") for i in range(60)] + [(1, i, "tool", f"No end {i}") for i in range(60, 120)] + [(1, i, "user", "Same.") for i in range(120, 200)] + [(2, 0, "assistant", "Ok.")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(5)
    got = {x.conv_id: tuple(x)[1:] for x in audit(as_given(df), 2).collect()}
    assert got == {k: brute_audit([r for r in rows if r[0] == k]) for k in (1, 2)}
    turns = sorted(tuple(x) for x in repaired(as_given(df), 2).where("conv_id = 2").collect())
    assert turns == [(2, 0, "user", "", "I"), (2, 1, "assistant", "Ok.", "K")]


def test_empty_table_lost_conversation_and_long_text(spark):
    from tidewire.llm.conversation_repair import audit, damage

    df = spark.createDataFrame([], KIND)
    assert audit(damage(df)).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    fine = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    long = "word " * 400_000 + "."
    df = spark.createDataFrame([(lost, 0, "user", "Gone.", 1, "", 1), (fine, 0, "user", long, 1, "", 1)], KIND)
    got = {x.conv_id: tuple(x)[1:] for x in audit(damage(df)).collect()}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[fine] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest())
