"""Filling containers of fixed capacity with items (minimum bin slack).

Only lengths decide where items fit, so the plan is made on the histogram of lengths, which has at most `capacity`
entries whatever the corpus. Per bin, a subset-sum over the lengths still available, with one bit per fill level, finds
the fullest combination that holds the longest item left; the combination is repeated while its lengths last, and is
removed. Each item then takes its place by its rank among the items of its length. Ranks are counted in two steps over
hashed buckets of a length, so a length that a third of the items share is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import cut

#: Stripes of ranks of a length, by which an item finds its combination.
STRIPES = 64
BUCKET_ROWS = 50_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Length -> number of items of the combination that fills `room` most; longer lengths are preferred."""
    lengths = sorted((x for x, n in counts.items() if 0 < x <= room and n > 0), reverse=True)
    mask = (1 << (room + 1)) - 1
    stages = [1]
    for x in lengths:
        reach, left, step = stages[-1], min(counts[x], room // x), 1
        while left > 0:  # 1, 2, 4, ... items of the length at once
            take = min(step, left)
            reach |= (reach << (take * x)) & mask
            left -= take
            step *= 2
        stages.append(reach)
        if reach >> room & 1:
            break
    fill = stages[-1].bit_length() - 1
    out: dict[int, int] = {}
    for i in range(len(stages) - 1, 0, -1):
        x = lengths[i - 1]
        n = 0
        while not stages[i - 1] >> fill & 1:
            fill -= x
            n += 1
        if n:
            out[x] = n
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins with it) until every item has a bin."""
    left = {x: n for x, n in counts.items() if n > 0}
    if any(x > capacity or x <= 0 for x in left):
        raise ValueError("an item's length isn't between 1 and the capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        mix = fullest(left, capacity - longest)
        left[longest] += 1
        mix[longest] = mix.get(longest, 0) + 1
        bins = min(left[x] // n for x, n in mix.items())
        out.append((mix, bins))
        for x, n in mix.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x]
    return out


def pieces(df: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(key, piece, start, n) of the items: one of more than `capacity` is cut into full pieces and a rest, all others stay whole. Items of length 0 or null need no room and give no row."""
    whole = df.select(F.col(key).alias("key"), F.col(length).cast("long").alias("len"))
    # no filter on the length: it would compute a length that is a UDF once more
    at = F.when(F.col("len") > 0, F.sequence(F.lit(0), F.greatest(F.ceil(F.col("len") / capacity) - 1, F.lit(0)).cast("int")))
    cut_up = whole.select("key", "len", F.explode(at).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut_up.select("key", "piece", start.alias("start"), F.least(F.col("len") - start, F.lit(capacity)).cast("int").alias("n"))


def pack(df: DataFrame, key: str, length: str, capacity: int = 1024) -> DataFrame:
    """(bin, place, key, piece, start, n): each item's bin, numbered from 0, and its place in it, in units of length.

    `start` is where the piece begins in its item. Rows of equal keys are items of their own. An empty table gives none.
    """
    spark = df.sparkSession
    items = cut(pieces(df, key, length, capacity))
    counts = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}
    slots, first_bin = [], 0
    used = dict.fromkeys(counts, 0)
    for mix, bins in plan_bins(counts, capacity):
        place = 0
        for n in sorted(mix, reverse=True):
            slots.append((n, used[n], used[n] + mix[n] * bins, mix[n], first_bin, place))
            used[n] += mix[n] * bins
            place += n * mix[n]
        first_bin += bins
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    sizes = items.groupBy("n", "bucket").count()
    ahead = sizes.select("n", "bucket", (F.sum("count").over(W.partitionBy("n").orderBy("bucket")) - F.col("count")).alias("ahead"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("n", "bucket").orderBy("key", "piece")) - 1).join(ahead, ["n", "bucket"])
    # as many rows as combinations of at most `capacity` lengths, and `STRIPES` more a length: its size doesn't follow the items'
    widths = {n: -(-count // STRIPES) for n, count in counts.items()}
    striped = [(s[0], stripe, *s[1:]) for s in slots for stripe in range(s[1] // widths[s[0]], (s[2] - 1) // widths[s[0]] + 1)]
    plan = spark.createDataFrame(striped, "n int, stripe long, rank_from long, rank_to long, per_bin int, first_bin long, first_place int")
    width = spark.createDataFrame(list(widths.items()), "n int, width long")
    rank = F.col("rank") + F.col("ahead")
    ranked = ranked.join(F.broadcast(width), "n").withColumn("stripe", F.floor(rank / F.col("width")))
    # an item meets the combinations of its stripe of ranks alone
    placed = ranked.join(F.broadcast(plan), ["n", "stripe"]).where((rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
    within = rank - F.col("rank_from")
    return placed.select(
        (F.col("first_bin") + F.floor(within / F.col("per_bin"))).cast("long").alias("bin"),
        (F.col("first_place") + (within % F.col("per_bin")) * F.col("n")).cast("int").alias("place"),
        "key", "piece", "start", "n",
    ).withColumnRenamed("key", key)
