"""Connected components of links, and links found inside groups of any size, block by block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top and x != top:
            self.up[x] = top
            x = above
        return top

    def join(self, a, b) -> bool:
        """True if ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


def _contract(kind: pa.DataType, most: int = 200_000) -> Callable:
    """Links that join what the given ones join, fewer; at most about ``most`` ids are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                union.join(a, b)
            if len(union.up) > most:
                yield from left(union)
                union = Union()
        yield from left(union)

    def left(union: Union) -> Iterator[pa.RecordBatch]:
        nodes = [x for x in union.up if union.root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([union.root(x) for x in part], kind)], ["a", "b"])

    return run


def connected_components(edges: DataFrame, one_task: int = 200_000) -> DataFrame:
    """(id, component) for every id that links (a, b) name; a component is its smallest id.

    Each partition first replaces its links by as many as join the same ids. If a count shows that at most
    ``one_task`` are left, one task joins those, which takes one pass where steps over many small partitions take
    a hundred. Else large-star and small-star steps, which move every neighbour to the smallest one
    known, alternate until nothing changes. What belongs to one id meets only in
    aggregates that combine before the shuffle, and in joins with their written result, whose
    hot ids Spark can split.
    """
    kind = dict(edges.dtypes)["a"]
    arrow = pa.int64() if kind == "bigint" else pa.binary()
    now = stored(edges.select("a", "b").mapInArrow(_contract(arrow), f"a {kind}, b {kind}").distinct(), "links")
    if now.limit(one_task + 1).count() <= one_task:
        now = stored(now.coalesce(1).mapInArrow(_contract(arrow, 2 * one_task), f"a {kind}, b {kind}"), "links")
        return _named(now)
    state = None
    while True:  # each link is (a, b) with a > b
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "links")
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == state:
            break
        state = seen
    return _named(now)


def _named(now: DataFrame) -> DataFrame:
    inner = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return inner.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


#: Given members (id, weight, payload, label) and, or None, others to hold them against,
#: yields pairs of ids that are linked; of those that links join already it may omit any.
Compare = Callable[[list[tuple], list[tuple] | None], Iterator[tuple]]


def _run(compare: Compare, kind: pa.DataType) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, members in groupby(rows(batches), key=lambda r: r[:3]):
            sides: tuple[dict, dict] = {}, {}
            for _, _, _, side, *member in members:
                sides[side][member[0]] = tuple(member)
            if len(sides[0]) + len(sides[1]) > 1:
                out.extend(compare(list(sides[0].values()), list(sides[1].values()) or None))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def linked(members: DataFrame, payload: DataFrame, compare: Compare, block_weight: int, block_members: int = 512, ratio: float | None = None) -> DataFrame:
    """Links (a, b) that join all ids which ``compare`` links inside some group.

    ``members`` has group, id and weight, ``payload`` the id and bytes of each.  A group is
    dealt by a hash of the id over blocks of about ``block_weight`` in total weight and at most about ``block_members``
    members, so no task holds a whole large group, and only links that join what was apart leave a
    task. If ids whose ``size`` differs by more than ``ratio`` are never linked, large groups are first split
    into classes of size; ids of neighbouring classes meet in one of them. In groups of more
    than one block, a first round compares inside blocks and with one hub member; a second holds all
    members outside the group's largest component against all blocks. Pairs that links join already need
    no comparison.
    """
    kind = dict(members.dtypes)["id"]
    arrow = pa.int64() if kind == "bigint" else pa.binary()

    def sized(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.min("id").alias("hub")).where("n > 1")
        blocks = F.ceil(F.greatest(F.col("total") / block_weight, F.col("n") / block_members)).cast("int").alias("blocks")
        return stored(found.select("group", "hub", blocks), "sizes")  # so that Spark can split a large group in the join

    sizes = sized(members)
    inside = members.join(sizes, "group")
    if ratio is not None and not sizes.where("blocks > 1").isEmpty():
        # A class spans four ratios; what lies within one of its upper end is in the next class too.
        place = F.log("size") / F.lit(4 * max(-math.log(ratio), 1e-6) * (1 + 1e-6))
        classes = F.array_distinct(F.array(F.floor(place), F.floor(place + 0.25)))
        many = bounded_broadcast(sizes.where("blocks > 1").select("group"), 200_000)  # so that members are not shuffled for them
        apart = members.join(many, "group", "left_semi").withColumn("class", F.explode(classes))
        key = F.xxhash64("group", "class")
        apart = apart.withColumn("group", F.encode(key.cast("string"), "UTF-8") if dict(members.dtypes)["group"] == "binary" else key)
        apart = stored(apart.drop("class"), "classes")
        alone = members.join(sizes.where("blocks = 1"), "group")
        inside = alone.unionByName(apart.join(sized(apart), "group").select(alone.columns))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0)
    inside = stored(inside.withColumn("block", own), "members")
    hubs = inside.where("id = hub and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = inside.unionByName(hubs).select("group", "block", F.lit(0).alias("other"), F.lit(0).alias("side"), "id", "weight", F.lit(None).cast(kind).alias("label"))

    def compared(tasks: DataFrame) -> DataFrame:
        ready = tasks.join(payload, "id").select("group", "block", "other", "side", "id", "weight", "payload", "label")
        ready = ready.repartition("group", "block", "other").sortWithinPartitions("group", "block", "other", "id")
        return stored(ready.mapInArrow(_run(compare, arrow), f"a {kind}, b {kind}"), "found")

    found = compared(first)
    large = inside.where("blocks > 1")
    if large.isEmpty():
        return found
    labels = connected_components(found)
    large = large.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    large = stored(large, "labelled")
    parts = large.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    main = parts.groupBy("group").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("w").alias("all"), F.sum("n").alias("members"), F.count("*").alias("k")).where("k > 1")
    strays = F.ceil(F.greatest((F.col("all") - F.col("w")) / block_weight, (F.col("members") - F.col("n")) / block_members)).cast("int")
    main = main.join(parts, "group").where("label = m.label").select("group", F.col("m.label").alias("main"), strays.alias("strays"))
    large = large.join(main, "group")
    stray = large.where("label != main").withColumn("other", F.pmod(F.xxhash64("id"), F.col("strays")).cast("int"))
    stray = stray.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    right = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strays") - 1))).withColumn("side", F.lit(1))
    names = ["group", "block", "other", "side", "id", "weight", "label"]
    return found.unionByName(compared(stray.select(names).unionByName(right.select(names))))
