"""Near-duplicates at ingest: the first earlier row that stays decides, in one ordered sweep over classes of titles.

Rows with one title and one time are a class: whatever decides on the first of them decides on all, so equal titles meet
only as one representative. Classes whose titles match form components, cut where 48 hours pass without a row; each
component is swept once in ingest order. A title's state is the time that kept rows cover, each stretch owned by the
earliest of them, so it holds about one stretch for each 48 hours whatever comes in, and a row costs one lookup.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.text import article_ts, cluster_id, norm_text
from tidewire.operators.graph import connected_components
from tidewire.operators.similarity import title_matches
from tidewire.session import stored

MICROS = 3_600_000_000
OWNER = "struct<ordinal: long, id: string, cluster: string>"


class Cover:
    """Stretches of time that kept rows cover, each with the row that covered it first."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.owners: list[tuple] = []
        self.first: tuple | None = None
        self.always: tuple | None = None

    def find(self, at: int | None) -> tuple | None:
        """The earliest row that covers a time; a row without a time is covered by the earliest of all."""
        if at is None:
            return self.first
        k = bisect_right(self.starts, at) - 1
        return self.owners[k] if k >= 0 and at <= self.ends[k] else self.always

    def add(self, at: int | None, reach: int, owner: tuple) -> None:
        """Cover what is free around a time; without one, all that is free."""
        self.first = self.first or owner
        if self.always is not None:
            return
        if at is None:
            self.always = owner
            return
        low, high = at - reach, at + reach
        k = bisect_right(self.starts, low) - 1
        if k >= 0 and self.ends[k] >= low:
            low = self.ends[k] + 1
        k += 1
        while low <= high:
            end = min(high, self.starts[k] - 1) if k < len(self.starts) else high
            if low <= end:
                self.starts.insert(k, low)
                self.ends.insert(k, end)
                self.owners.insert(k, owner)
                k += 1
            low = self.ends[k] + 1 if k < len(self.starts) else high + 1
            k += 1


def usable(owner: tuple, has_id: bool) -> bool:
    """Whether a match names a cluster: it has one, or both rows have ids to name one."""
    return bool((owner[2] or "").strip()) or (owner[1] is not None and has_id)


def _sweep(rows: DataFrame, hours: int) -> DataFrame:
    """(class, match) from rows (piece, kind, rank, title, other, class, at, old, has_id, owner): links of titles come first."""
    reach = hours * MICROS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, covers, links = None, {}, {}
        for b in batches:
            names, found = [], []
            for now, kind, title, other, name, at, old, has_id, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != piece:
                    piece, covers, links = now, {}, {}
                if kind == 0:
                    links.setdefault(title, []).append(other)
                    continue
                mine = (owner["ordinal"], owner["id"], owner["cluster"])
                match = None if old else covers[title].find(at) if title in covers else None
                if match is None or not usable(match, has_id):
                    for t in (title, *links.get(title, ())):
                        covers.setdefault(t, Cover()).add(at, reach, mine)
                if not old:
                    names.append(name)
                    found.append(None if match is None else dict(zip(("ordinal", "id", "cluster"), match, strict=True)))
            kind = pa.struct([("ordinal", pa.int64()), ("id", pa.string()), ("cluster", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, kind)], names=["class", "match"])

    return rows.mapInArrow(run, f"class string, match {OWNER}")


def _narrow(df: DataFrame, old: bool) -> DataFrame:
    cluster = F.col("narrative_cluster_id") if "narrative_cluster_id" in df.columns else F.lit(None).cast("string")
    live = df.where(F.coalesce(F.col("status") != "irrelevant", F.lit(True))) if "status" in df.columns else df
    rows = live.select(F.col("ordinal").cast("long").alias("ordinal"), "id", cluster.alias("cluster"), F.unix_micros(article_ts()).alias("at"), norm_text("title").alias("t"), F.lit(old).alias("old")).where("t <> ''")
    name = F.concat_ws(":", F.md5("t"), F.coalesce(F.col("at").cast("string"), F.lit("-")), F.col("id").isNotNull().cast("string"), F.col("old").cast("string"))
    return rows.withColumn("class", name)


def _pieces(classes: DataFrame, links: DataFrame, hours: int) -> tuple[DataFrame, DataFrame]:
    """Classes and links with their ``piece``: a component of titles, between gaps of over ``hours``; one with a row without a
    time is not cut."""
    groups = connected_components(links, "x", "y").select(F.col("node").alias("title"), "component")
    classes = classes.join(groups.hint("merge"), "title", "left").withColumn("component", F.coalesce("component", "title"))
    classes = stored(classes.withColumn("bucket", F.floor(F.col("at") / (hours * MICROS))), "classes")
    order = W.partitionBy("component").orderBy("bucket")
    runs = classes.select("component", "bucket").distinct().withColumn("timeless", F.max(F.col("bucket").isNull()).over(W.partitionBy("component")))
    fresh = ~F.col("timeless") & F.coalesce(F.col("bucket") - F.lag("bucket").over(order) > 1, F.lit(True))
    runs = runs.withColumn("fresh", fresh.cast("int"))
    runs = stored(runs.select("component", "bucket", F.concat_ws(":", "component", F.sum("fresh").over(order).cast("string")).alias("piece")), "pieces")
    same = (F.col("r.component") == F.col("c.component")) & F.col("r.bucket").eqNullSafe(F.col("c.bucket"))
    classes = classes.alias("c").join(runs.alias("r").hint("merge"), same).select("c.*", "r.piece")
    where = stored(classes, "swept")
    links = links.join(where.select(F.col("title").alias("x"), "piece").distinct().hint("merge"), "x")
    return where, links


def first_wins(rows: DataFrame, existing: DataFrame | None = None, hours: int = vocab.WINDOW_HOURS, jaccard: float = vocab.JACCARD, long: int = 20) -> DataFrame:
    """(ordinal, id, kept_by, duplicate, narrative_cluster_id) for each row that an earlier one matches, in ingest order.

    Rows are judged by ordinal, after all ``existing`` ones. Of the earlier rows that stay, the first whose title is equal,
    contained or of similar words within ``hours`` is ``kept_by``; a row without a time matches any. Its cluster is the row's, or
    else the name of the pair; a match that names no cluster (an id is missing) ends the search, and the row stays. Rows that
    are irrelevant or have no title neither match nor are matched; equal ordinals go by id.
    """
    narrow = _narrow(rows, False)
    if existing is not None:
        narrow = narrow.unionByName(_narrow(existing, True))
    narrow = stored(narrow, "narrow")
    one = F.struct("ordinal", "id", "cluster")
    classes = narrow.groupBy("class", "t", "at", "old").agg(F.min(one).alias("owner"))
    classes = classes.select("class", "t", F.md5("t").alias("title"), "at", "old", F.col("owner.id").isNotNull().alias("has_id"), "owner")
    links = title_matches(narrow.select("t").distinct(), jaccard, long)
    links = stored(links.select(F.md5("x").alias("x"), F.md5("y").alias("y")), "links")
    classes, linked = _pieces(classes.drop("t"), links, hours)
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["piece", "kind", "title", "other", "class", "at", "old", "has_id", "owner"]
    first = linked.select("piece", F.lit(0).alias("kind"), F.col("x").alias("title"), F.col("y").alias("other"), none("string").alias("class"), none("long").alias("at"), none("boolean").alias("old"), none("boolean").alias("has_id"), none(OWNER).alias("owner"))
    then = classes.select("piece", F.lit(1).alias("kind"), "title", none("string").alias("other"), "class", "at", "old", "has_id", F.col("owner").cast(OWNER).alias("owner"))
    both = first.unionByName(then).repartition("piece").sortWithinPartitions("piece", "kind", F.desc("old"), "owner.ordinal", "owner.id")
    judged = _sweep(both.select(columns), hours).join(classes.select("class", "owner").hint("merge"), "class")
    # written, so that the rows of a large class are split between tasks that meet its one result
    judged = stored(judged, "judged")
    met = narrow.where("NOT old").join(judged.hint("merge"), "class")
    itself = (F.col("ordinal") == F.col("owner.ordinal")) & F.col("id").eqNullSafe(F.col("owner.id"))
    met = met.withColumn("by", F.coalesce("match", F.when(~itself, F.col("owner")))).where("by IS NOT NULL")
    return met.select("ordinal", "id", F.col("by.ordinal").alias("kept_by"), resolved(F.col("by"), F.col("id")).alias("narrative_cluster_id")).withColumn("duplicate", F.col("narrative_cluster_id").isNotNull())


def resolved(by: Column, own: Column) -> Column:
    """The cluster of the matched row, or the name of the pair; null where an id is missing."""
    held = F.when(F.trim(by["cluster"]) != "", by["cluster"])
    return F.coalesce(held, F.when(by["id"].isNotNull() & own.isNotNull(), cluster_id(F.array(by["id"], own))))
