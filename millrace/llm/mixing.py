"""Mixing sources to target weights.

The size of the mixture, by default that of all records that can be mixed, is cut into blocks of equal size. Blocks go to
the sources by the highest quotients (Sainte-Lague), no source beyond `max_repeats` times its own size; what a source
can't fill goes to the others by the same quotients. A source's quota is split over its shards in the same way, and within
a shard the records stand in seeded order, where a seeded rotation selects the blocks that are taken once more than the
others.

Shards are made by hash, one for about `SHARD_ROWS` records and at most `SHARDS` a source, so the driver sees a bounded
number of them whatever the number of records. A shard of more records is cut into stretches of its order, whose sums are
added up in a table; so no task sorts more than about `SHARD_ROWS` records, and a source that holds a third of all rows
is many tasks.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.cutoffs import finite
from millrace.session import bounded_rows, cut, drop

SHARD_ROWS, SHARDS, SOURCES = 100_000, 256, 10_000


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by the highest quotients weight / (2 k + 1), no key beyond its cap; ties go to the lesser key. If all caps are full, seats stay free.

    A divisor is found by bisection first, so the cost doesn't follow the number of seats; only the last few seats are given one by one.
    """
    keys = sorted(k for k, w in weights.items() if w > 0)
    cap = {k: seats if caps is None else min(seats, int(caps[k])) for k in keys}
    seats = min(seats, sum(cap.values()))
    if seats <= 0 or not keys:
        return dict.fromkeys(weights, 0)

    def given(divisor: float) -> dict:
        return {k: min(cap[k], int(weights[k] / divisor + 0.5)) for k in keys}

    lo, hi = min(weights[k] for k in keys) / (4.0 * seats + 4), 4.0 * sum(weights[k] for k in keys)
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if sum(given(mid).values()) > seats - len(keys):
            lo = mid
        else:
            hi = mid
    out = given(hi)
    # below the bisected divisor by rounding: step back so that every seat left is given by its quotient
    out = {k: max(0, n - 2) for k, n in out.items()}
    heap = [(-weights[k] / (2 * out[k] + 1), k) for k in keys if out[k] < cap[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < cap[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return {k: out.get(k, 0) for k in weights}


def mixable(df: DataFrame, sources: DataFrame, size: str, key: str = "id", source: str = "source") -> DataFrame:
    """(key, source, size) of each record once: its source has a weight, its size is finite and above 0. Rows without key are no records; deliveries that differ count by their least size."""
    bounded_rows(sources.select(source), SOURCES, "the list of sources")
    listed = F.broadcast(sources.where(finite(F.col("weight").cast("double"))).select(source).distinct())
    amount = F.col(size).cast("double")
    kept = df.select(key, source, amount.alias("size")).where(F.col(key).isNotNull() & finite(F.col("size")) & (F.col("size") > 0))
    return kept.join(listed, source).groupBy(key, source).agg(F.min("size").alias("size"))


class Plan:
    """Blocks by source: weight, repeats, sums (records, size), share, aim, cap, quota, short; `records` are the mixable records, computed once."""

    def __init__(self, df: DataFrame, sources: DataFrame, size: str, key: str, source: str, total: float | None, block: float):
        listed = bounded_rows(sources.where(finite(F.col("weight").cast("double"))).dropDuplicates([source]), SOURCES, "the list of sources")
        if any(r["weight"] < 0 for r in listed):
            raise ValueError("a weight is negative")
        self.weight = {r[source]: float(r["weight"]) for r in listed if r[source] is not None}
        self.repeats = {r[source]: max(0, 1 if r["max_repeats"] is None else int(r["max_repeats"])) for r in listed if r[source] is not None}
        self.records = cut(mixable(df, sources, size, key, source))
        self.sums = {r[source]: (r["n"], r["size"]) for r in self.records.groupBy(source).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        self.aim = sum(s for _, s in self.sums.values()) if total is None else total
        self.share = {s: w / (sum(self.weight.values()) or 1.0) for s, w in self.weight.items()}
        most = {s: self.repeats[s] * self.sums.get(s, (0, 0.0))[1] for s in self.weight}
        # whole blocks that a source can fill with all its repeats
        self.cap = {s: int(x / block + 1e-9) for s, x in most.items()}
        self.quota = sainte_lague(self.weight, round(self.aim / block), self.cap)
        self.short = short_sources(self.quota, self.cap, self.share, most, self.aim)


def short_of_share(df: DataFrame, sources: DataFrame, size: str, key: str = "id", source: str = "source", total: float | None = None, block: float = 30.0) -> DataFrame:
    """(source) of the sources that can't reach their share, by the apportionment of `mix` without its selection of records."""
    plan = Plan(df, sources, size, key, source, total, block)
    drop(plan.records)
    kind = df.schema[source].dataType.simpleString()
    return df.sparkSession.createDataFrame([(s,) for s in sorted(plan.short)], f"{source} {kind}")


def mix(df: DataFrame, sources: DataFrame, size: str, key: str = "id", source: str = "source", total: float | None = None, block: float = 30.0, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: key, source, size and `copies` (1 or more) of each record that is taken. report: one row per weighted source:
    size, target and reached size and share, records, copies, and whether `short`: max_repeats times its size doesn't reach
    its share of the total. Sources without weight aren't mixed; null max_repeats counts as 1; a source without any
    record is reported with size 0. `total` is the size of the mixture, by default that of all mixable records.
    """
    spark = df.sparkSession
    kind = df.schema[source].dataType.simpleString()
    p = Plan(df, sources, size, key, source, total, block)
    placed, stretches, parts = _placed(p.records, p.sums, key, source, block, seed)
    blocks: dict = {}
    for r in parts:
        blocks.setdefault(r[source], {})[r["shard"]] = max(1, round(r["size"] / block))
    plan = []
    for s, own in blocks.items():
        by_shard = sainte_lague(own, p.quota.get(s, 0), {j: p.repeats[s] * n for j, n in own.items()})
        plan += [(s, j, n, by_shard[j]) for j, n in own.items()]
    # at most SHARDS rows a source
    table = F.broadcast(spark.createDataFrame(plan, f"{source} {kind}, shard long, blocks long, quota long"))
    turn = F.pmod(F.least("block", F.col("blocks") - 1) + F.pmod(F.xxhash64(source, "shard", F.lit(seed + 2)), "blocks"), "blocks")
    copies = F.floor(F.col("quota") / F.col("blocks")) + F.when(turn < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    mixture = cut(placed.join(table, [source, "shard"]).withColumn("copies", copies.cast("int")).where("copies > 0").select(key, source, "size", "copies"))
    for used in (p.records, stretches):
        drop(used)
    got = {r[source]: r for r in mixture.groupBy(source).agg(F.sum(F.col("size") * F.col("copies")).alias("reached"), F.count("*").alias("records"), F.max("copies").alias("most")).collect()}
    reached = sum(r["reached"] for r in got.values()) or 1.0
    rows = []
    for s in sorted(p.weight):
        r = got.get(s)
        rows.append((s, p.sums.get(s, (0, 0.0))[1], p.share[s], p.share[s] * p.aim, r["reached"] if r else 0.0, (r["reached"] if r else 0.0) / reached, r["records"] if r else 0, r["most"] if r else 0, p.quota[s], p.cap[s], s in p.short))
    report = spark.createDataFrame(rows, f"{source} {kind}, own_size double, target_share double, target_size double, reached_size double, reached_share double, n_records long, most_copies int, quota_blocks long, most_blocks long, short boolean")
    return mixture, report


def short_sources(quota: dict, cap: dict, share: dict, most: dict, aim: float) -> set:
    """The sources that can't reach their share: those whose quota the apportionment held at their cap, and of these the ones for which an exact comparison confirms it.

    A quota lies below its fair number of blocks by no more than rounding: half a block, half a block of the total, and the
    source's share of what n quotas were rounded up by, n / 2. So no short source's quota lies further below its cap.
    """
    slack = {s: 2 + math.ceil(share[s] * len(share) / 2) for s in share}
    held = {s for s in quota if quota[s] >= cap[s] - slack[s]}
    return {s for s in held if most[s] < share[s] * aim}


def _placed(records: DataFrame, sums: dict, key: str, source: str, block: float, seed: int) -> tuple[DataFrame, DataFrame, list]:
    """(key, source, size, shard, block) of the records, the table of stretches it reads, and the size of each shard: the block is the record's place in its shard's seeded order."""
    spark = records.sparkSession
    kind = records.schema[source].dataType.simpleString()
    cuts = []
    for s, (n, _) in sums.items():
        shards = min(SHARDS, max(1, -(-n // SHARD_ROWS)))
        cuts.append((s, shards, max(1, -(-n // (shards * SHARD_ROWS)))))
    table = F.broadcast(spark.createDataFrame(cuts, f"{source} {kind}, shards long, stretches long"))
    order = F.xxhash64(key, F.lit(seed))
    of = records.join(table, source).withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(seed + 1)), "shards").cast("long"))
    # the stretch grows with the order, so stretches of a shard are runs of its order
    of = of.withColumn("stretch", F.least(F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * F.col("stretches")), F.col("stretches") - 1))
    within = F.sum("size").over(W.partitionBy(source, "shard", "stretch").orderBy("order", key).rowsBetween(W.unboundedPreceding, -1))
    before = F.sum("size").over(W.partitionBy(source, "shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    stretches = cut(of.groupBy(source, "shard", "stretch").agg(F.sum("size").alias("size")))
    starts = stretches.select(source, "shard", "stretch", F.coalesce(before, F.lit(0.0)).alias("before"))
    placed = of.withColumn("within", F.coalesce(within, F.lit(0.0))).join(starts, [source, "shard", "stretch"])
    parts = stretches.groupBy(source, "shard").agg(F.sum("size").alias("size")).collect()
    return placed.select(key, source, "size", "shard", F.floor((F.col("before") + F.col("within")) / block).alias("block")), stretches, parts
