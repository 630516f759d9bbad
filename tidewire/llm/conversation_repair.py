"""Conversation structure repair: cheapest edits to alternating roles, by rank-convergence parallel Viterbi.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Each row is kept (K), given the role user or
assistant (R) or deleted (D), and empty rows may be inserted anywhere (I); the cheapest edits win, then the ASCII-least
letters. That is a shortest path over four states: nothing out yet, last out s, u or a.

The path is not searched conversation by conversation, as one of them may hold a third of all rows. Rows without their
texts are sorted over the whole cluster and cut into blocks of ``BLOCK`` places, whatever conversations they are of.

1. Every block runs backwards from four speculative cost vectors, one for each state. Any true cost vector is a minimum of
   these four plus constants, so what the block makes of it follows from the four results.
2. Where the four results differ only by constants, the block has converged and its head is known whatever follows. Fix-up
   passes run on the others: a block goes on through what follows it, twice as far in each pass, until its vectors differ
   only by constants. The last row of a conversation makes them so at once.
3. With the true vector behind each block its backward costs are stitched, and letters are traced forwards, from all four
   states at first, with the same fix-up for the states at which blocks begin, then from the true one.

Texts are shuffled once, for the end: they follow the letters of their conversation, in order, through one task that keeps
no text. SHA-256 of a whole conversation is one sequential pass by its nature, whatever the plan.

Defined cases: rows are taken by turn, nulls first, then by role and digest of the text, so repeated rows have one result.
A null role or text is one space, so the role is in no order and the text is blank; null ids are one conversation. An
empty table gives an empty table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.places import in_order
from tidewire.session import cut, forget, stored

BLOCK_BITS = 8
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"

#: States: nothing out, last out s, u, a. Classes of rows: s, u, a, other. Faults: none, truncated, blank, duplicate.
START, S, U, A = range(4)
NO_WAY = 1 << 20
FAULTS = ("none", "truncated", "blank", "duplicate")
#: Inserts that the end still needs, by state, and what they cost.
ENDING = np.array([0, 2, 1, 0])
FINAL = ENDING * INSERT
#: [k, q]: state q never costs more than state k and so much, whatever follows: it may insert its way to k, and delete an s.
SPECULATIVE = np.array([[0, 6, 7, 4], [0, 0, 3, 0], [3, 3, 0, 3], [6, 6, 3, 0]])
NEXT = {START: U, S: U, U: A, A: U}
#: Letters of a row with the inserts before it, in ASCII order; more inserts never pay.
SEGMENTS = sorted("I" * n + op for n in range(3) for op in "DKR")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(cost, state after) of [code, state, segment], where code is 4 * class + fault."""
    cost, after = np.full((16, 4, len(SEGMENTS)), NO_WAY), np.zeros((16, 4, len(SEGMENTS)), int)
    for code in range(16):
        kind, fault = divmod(code, 4)
        for state in range(4):
            for j, segment in enumerate(SEGMENTS):
                at, paid = state, INSERT * (len(segment) - 1)
                for _ in segment[1:]:
                    at = NEXT[at]
                if segment[-1] == "D":
                    cost[code, state, j], after[code, state, j] = paid + DELETE, at
                elif fault < 2:
                    to = NEXT[at] if segment[-1] == "R" else {0: S if at == START else None, 1: U if at != U else None, 2: A if at == U else None}.get(kind)
                    if to is not None:
                        cost[code, state, j] = paid + REROLE * (segment[-1] == "R") + TRUNCATED * fault
                        after[code, state, j] = to
    return cost, after


COST, AFTER = _tables()
STEP = np.full((16, 4, 4), NO_WAY)
for _q in range(4):
    for _j in range(len(SEGMENTS)):
        np.minimum.at(STEP, (np.arange(16), _q, AFTER[:, _q, _j]), COST[:, _q, _j])


# ---- the rows ----


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: damage by crc32(``conv_id:turn``) % 20. 0 drops a row (no copy), 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 gives it the role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).alias("harm"))
    return out.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


def as_given(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns of rows that are taken as they are."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


ORDER = ("turn", "role", "digest")


def _coded(rows: DataFrame) -> DataFrame:
    """One row for each copy, without its text: ``(conv_id, turn, role, digest, code)``. Duplicates are not told yet."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((kind > 0) & (F.col("role") != ""), kind - 1).otherwise(3)
    fault = F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    out = rows.where("copies > 0").select("conv_id", "turn", "role", _digest(), (kind * 4 + fault).cast("tinyint").alias("code"), "copies")
    return out.select("conv_id", "turn", "role", "digest", "code", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def blocks(placed: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(block, rows)``: the rows (place, conv_id, code) of 2^``bits`` places each, duplicates told, and one more on either side.

    The first place of each (conversation, role, text) comes from an aggregate that combines before its shuffle; first places
    meet their rows in the shuffle by block, so no group of equal rows meets in one task.
    """
    block, size = F.shiftright("place", bits), 1 << bits
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    within = F.col("place") % size
    beside = F.array_compact(F.array(block, F.when((within == 0) & (F.col("place") > 0), block - 1), F.when(within == size - 1, block + 1)))
    kind = placed.schema["conv_id"].dataType
    every = placed.select(F.explode(beside).alias("block"), "place", "conv_id", "code", F.lit(False).alias("first"))
    every = every.unionByName(first.select(block.alias("block"), "place", F.lit(None).cast(kind).alias("conv_id"), F.lit(None).cast("tinyint").alias("code"), F.lit(True).alias("first")))
    one = every.repartition("block").groupBy("block", "place").agg(F.max("conv_id").alias("conv_id"), F.max("code").alias("code"), F.bool_or("first").alias("first")).where("code IS NOT NULL")
    code = F.when(~F.col("first") & (F.col("code") % 4 != 2), F.col("code") - F.col("code") % 4 + 3).otherwise(F.col("code")).cast("tinyint")
    return one.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "conv_id", code.alias("code")))).alias("rows"))


class _Batch:
    """Blocks as arrays of one row a block: codes, where conversations begin and end, the class of the row before each row."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        self.block = batch.column("block").to_numpy(zero_copy_only=False)
        rows, size = batch.column("rows"), 1 << bits
        flat, n = rows.flatten(), len(self.block)
        where = np.repeat(np.arange(n), np.diff(rows.offsets.to_numpy()))
        place = flat.field("place").to_numpy(zero_copy_only=False) - self.block[where] * size + 1  # 0 and size + 1: the neighbours
        self.conv = flat.field("conv_id")
        conv = pd.factorize(self.conv.to_pandas(), use_na_sentinel=False)[0]
        ids, codes = np.full((n, size + 2), -1), np.zeros((n, size + 2), np.int64)
        ids[where, place], codes[where, place] = conv, flat.field("code").to_numpy(zero_copy_only=False)
        self.at = np.full((n, size + 2), -1)
        self.at[where, place] = np.arange(len(where))
        self.there = ids[:, 1:-1] >= 0
        self.starts = ids[:, 1:-1] != ids[:, :-2]
        self.ends = (ids[:, 1:-1] != ids[:, 2:]) & self.there
        self.codes, self.before, self.at = codes[:, 1:-1], codes[:, :-2] // 4, self.at[:, 1:-1]

    def backward(self, behind: np.ndarray, keep: bool = False) -> np.ndarray:
        """Cost vectors (block, k, state) at the head of each block from those behind it; with ``keep`` those behind each row."""
        costs, kept = behind.astype(np.int64), []
        for i in range(self.codes.shape[1] - 1, -1, -1):
            costs = np.where(self.ends[:, i, None, None], FINAL, costs)
            kept.append(costs)
            new = (STEP[self.codes[:, i]][:, None] + costs[:, :, None, :]).min(-1)
            costs = np.where(self.there[:, i, None, None], new - new.min(-1, keepdims=True).min(1, keepdims=True), costs)
        return np.stack(kept[::-1], 1) if keep else costs

    def forward(self, states: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments (block, row, k) on the least cheapest way from states (block, k), and the states at the end."""
        out = np.zeros((*self.codes.shape, states.shape[1]), np.int8)
        rows = np.arange(len(states))[:, None, None]
        for i in range(self.codes.shape[1]):
            states = np.where(self.starts[:, i, None], START, states)
            code = self.codes[:, i, None]
            after = AFTER[code, states]
            out[:, i] = best = (COST[code, states] + costs[rows, i, 0, after]).argmin(-1)
            states = np.where(self.there[:, i, None], np.take_along_axis(after, best[:, :, None], 2)[:, :, 0], states)
        return out, states


def _by_batch(df: DataFrame, make: Callable[[_Batch, pa.RecordBatch], pa.RecordBatch], schema: str, bits: int, most: int = 1 << 18) -> DataFrame:
    size = max(1, most >> bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, size):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(k, size)]) for c in whole.columns], names=whole.schema.names)
                yield make(_Batch(part, bits), part)

    return df.mapInArrow(run, schema)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values.reshape(len(values), -1)), pa.list_(pa.int32()))


def _stack(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), *shape)


# ---- convergence and fix-up passes over blocks ----


def _through(own: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Speculative results of a span from those of its first part and of the part behind it: (n, k, state) each."""
    new = (behind[:, :, :, None] + own[:, None, :, :]).min(2)
    return new - new.min(-1, keepdims=True).min(1, keepdims=True)


def _parallel(v: np.ndarray) -> np.ndarray:
    """Whether the vectors of each span differ only by constants."""
    v = v - v[:, :, :1]
    return (v == v[:, :1]).all((1, 2))


def _on(own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """State after a span, by the state before the part in front of it."""
    return np.take_along_axis(own, before, 1)


def _same(v: np.ndarray) -> np.ndarray:
    return (v == v[:, :1]).all(1)


def _fix_up(spans: DataFrame, step: int, shape: tuple[int, ...], through: Callable, done: Callable) -> DataFrame:
    """(block, vectors) with ``done`` vectors, from spans (block, vectors) of one block each.

    A span that is not done goes on through the span of the block where it ends, so its length doubles in each pass. The
    block at the edge of the table is always done, so every span ends. One number a pass reaches the driver.
    """
    spans = cut(spans.select("block", "vectors", (F.col("block") + step).alias("to"), "done"))
    while spans.where("NOT done").limit(1).count():
        there = spans.select(F.col("block").alias("to"), F.col("vectors").alias("met"), F.col("to").alias("further"))
        met = spans.where("NOT done").join(there.hint("shuffle_hash"), "to").select("block", "vectors", "met", "further")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = through(_stack(b.column("vectors"), *shape), _stack(b.column("met"), *shape))
                yield pa.RecordBatch.from_arrays([b.column("block"), _lists(v), b.column("further"), pa.array(done(v))], names=["block", "vectors", "to", "done"])

        spans = cut(spans.where("done").unionByName(met.mapInArrow(run, "block long, vectors array<int>, to long, done boolean")))
    return spans.select("block", "vectors")


def heads(of: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(block, vectors): costs of what follows from the head of each block, by state, up to a constant."""

    def make(b: _Batch, _: pa.RecordBatch) -> pa.RecordBatch:
        v = b.backward(np.broadcast_to(SPECULATIVE, (len(b.block), 4, 4)))
        return pa.RecordBatch.from_arrays([pa.array(b.block), _lists(v), pa.array(_parallel(v))], names=["block", "vectors", "done"])

    return _fix_up(_by_batch(of, make, "block long, vectors array<int>, done boolean", bits), 1, (4, 4), _through, _parallel).select("block", F.slice("vectors", 1, 4).alias("vectors"))


def _behind(b: _Batch, tail: pa.Array) -> np.ndarray:
    rows = [FINAL if t is None else t for t in tail.to_pylist()]
    return np.array(rows, np.int64).reshape(-1, 1, 4)


def entries(of: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(block, vectors): the state at the end of each block, from blocks with their ``tail``; four equal numbers."""

    def make(b: _Batch, batch: pa.RecordBatch) -> pa.RecordBatch:
        _, states = b.forward(np.broadcast_to(np.arange(4), (len(b.block), 4)), b.backward(_behind(b, batch.column("tail")), keep=True))
        return pa.RecordBatch.from_arrays([pa.array(b.block), _lists(states), pa.array(_same(states))], names=["block", "vectors", "done"])

    return _fix_up(_by_batch(of, make, "block long, vectors array<int>, done boolean", bits), -1, (4,), _on, _same)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def runs(of: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(conv_id, place, letters, blank, duplicate, truncated, illegal, cost)`` for each part of a conversation in a block, from
    blocks with ``tail`` and ``entry``."""
    kind = of.schema["rows"].dataType.elementType["conv_id"].dataType.simpleString()

    def make(b: _Batch, batch: pa.RecordBatch) -> pa.RecordBatch:
        entry = np.array([START if e is None else e for e in batch.column("entry").to_pylist()], np.int64)[:, None]
        costs = b.backward(_behind(b, batch.column("tail")), keep=True)
        picked, _ = b.forward(entry, costs)
        picked = picked[:, :, 0]
        # states again, to know what the end of a conversation still needs
        states, ending = entry[:, 0], np.zeros(picked.shape, np.int64)
        for i in range(picked.shape[1]):
            states = AFTER[b.codes[:, i], np.where(b.starts[:, i], START, states), picked[:, i]]
            ending[:, i] = np.where(b.ends[:, i], ENDING[states], 0)
        kinds, fault = np.divmod(b.codes, 4)
        legal = ((b.before == 0) & (kinds == 1)) | ((b.before == 1) & (kinds == 2)) | ((b.before == 2) & (kinds == 1))
        paid = np.array([INSERT * (len(s) - 1) + {"D": DELETE, "R": REROLE, "K": 0}[s[-1]] for s in SEGMENTS])[picked] + TRUNCATED * ((fault == 1) & ~np.isin(picked, [j for j, s in enumerate(SEGMENTS) if s[-1] == "D"])) + INSERT * ending
        there = b.there.ravel()
        fresh = b.starts.copy()
        fresh[:, 0] = True
        fresh = fresh.ravel()[there]
        at = np.flatnonzero(fresh)
        total = lambda x: pa.array(np.add.reduceat(x.ravel()[there].astype(np.int64), at) if len(at) else np.zeros(0, np.int64))
        words = [SEGMENTS[p] + "I" * e for p, e in zip(picked.ravel()[there].tolist(), ending.ravel()[there].tolist(), strict=True)]
        edges = [*at.tolist(), len(words)]
        letters = pa.array(["".join(words[i:j]) for i, j in zip(edges, edges[1:], strict=False)], pa.string())
        place = (b.block[:, None] << bits) + np.arange(1 << bits)
        conv = b.conv.take(pa.array(b.at.ravel()[there][at]))
        parts = [conv, pa.array(place.ravel()[there][at]), letters, total(fault == 2), total(fault == 3), total(fault == 1), total(~legal & ~b.starts), total(paid)]
        return pa.RecordBatch.from_arrays(parts, names=["conv_id", "place", "letters", *COUNTS])

    return _by_batch(of, make, f"conv_id {kind}, place long, letters string, " + ", ".join(f"{c} long" for c in COUNTS), bits)


def edits(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The ``runs`` of the cheapest edits of all conversations of rows ``(conv_id, turn, role, text, copies)``."""
    placed = in_order(_coded(rows), ("conv_id", *ORDER), "turns")
    cuts = stored(blocks(placed, bits), "blocks")
    forget(placed)
    tails = heads(cuts, bits).select((F.col("block") - 1).alias("block"), F.col("vectors").alias("tail"))
    whole = cuts.join(tails.hint("merge"), "block", "left")
    entry = entries(whole, bits).select((F.col("block") + 1).alias("block"), F.element_at("vectors", 1).alias("entry"))
    return runs(whole.join(entry.hint("merge"), "block", "left"), bits)


# ---- texts along the letters ----


class _Walk:
    """One conversation, row by row: its repaired rows, their digest, and the turns seen."""

    def __init__(self, conv: object):
        self.conv, self.parts, self.counts = conv, [], [0] * len(COUNTS)
        self.audit, self.at, self.state, self.out = None, 0, START, 0
        self.sha = hashlib.sha256()
        self.low = self.high = self.last = None
        self.distinct = 0

    def _emit(self, role: str, text: str, op: str, to: int) -> tuple[int, str, str, str]:
        self.sha.update((f"\n{role}:{text}" if self.out else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.out, self.state = self.out + 1, to
        return self.out - 1, role, text, op

    def _insert(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            to = NEXT[self.state]
            yield self._emit("user" if to == U else "assistant", "", "I", to)

    def row(self, turn: int | None, role: str, text: str, copies: int) -> Iterator[tuple[int, str, str, str]]:
        if self.audit is None:
            self.audit = "".join(self.parts)
        if turn is not None and copies:
            if turn != self.last:
                self.distinct += 1
            self.last = self.high = turn
            self.low = turn if self.low is None else self.low
        for _ in range(copies):
            yield from self._insert()
            op, self.at = self.audit[self.at], self.at + 1
            if op == "R":
                to = NEXT[self.state]
                yield self._emit("user" if to == U else "assistant", text, op, to)
            elif op == "K":
                yield self._emit(role, text, op, {"s": S, "u": U, "a": A}[role[0]])

    def end(self) -> Iterator[tuple[int, str, str, str]]:
        if self.audit is None:
            self.audit = "".join(self.parts)
        yield from self._insert()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _follow(rows: DataFrame, runs_: DataFrame, schema: str, turns: bool) -> DataFrame:
    """Letters first, then the texts of each conversation in order, through one task a conversation that keeps no text."""
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), none("long").alias("place"), F.col("turn").cast("long").alias("turn"), "role", F.when(F.col("copies") > 0, F.unhex(F.sha2("text", 256))).alias("digest"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), F.col("copies").cast("int").alias("copies"), none("string").alias("letters"), *(none("long").alias(c) for c in COUNTS))
    marks = runs_.select("conv_id", F.lit(0).alias("kind"), "place", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), none("int").alias("copies"), "letters", *COUNTS)
    both = texts.unionByName(marks).repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "place", *ORDER)))
    both = both.select("conv_id", "kind", "turn", "role", "text", "copies", "letters", *COUNTS)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None
        out: list[tuple] = []

        def close() -> None:
            done = walk.end()
            if turns:
                out.extend((walk.conv, *x) for x in done)
            else:
                for _ in done:
                    pass
                out.append((walk.conv, walk.gaps(), *walk.counts, walk.audit, walk.sha.hexdigest()))

        for b in batches:
            for conv, kind, turn, role, text, copies, letters, *counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        close()
                    walk = _Walk(conv)
                if kind == 0:
                    walk.parts.append(letters)
                    walk.counts = [x + y for x, y in zip(walk.counts, counts, strict=True)]
                else:
                    for x in walk.row(turn, role, text, copies):
                        if turns:
                            out.append((conv, *x))
            if out:
                yield _rows(out)
                out = []
        if walk is not None:
            close()
            if out:
                yield _rows(out)

    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [pa.from_numpy_dtype(np.int64) if f.split()[1] in ("bigint", "long") else kinds.get(f.split()[1]) for f in schema.split(", ")]

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return both.mapInArrow(run, schema)


def audit(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Per conversation of rows ``(conv_id, turn, role, text, copies)``: ``gaps`` in the turns, rows whose first fault is blank,
    duplicate or truncated, ``illegal`` neighbours, ``cost`` and letters of the cheapest edits, digest of the repaired rows.

    A conversation without rows (all ``copies`` are 0) has zeros, no letters and the digest of an empty string.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _follow(rows, edits(rows, bits), f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string", False)


def repaired(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The repaired rows ``(conv_id, place, role, text, edit)`` of rows ``(conv_id, turn, role, text, copies)``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _follow(rows, edits(rows, bits), f"conv_id {kind}, place long, role string, text string, edit string", True)
