"""Score cutoffs that keep a target fraction of each source.

A mergeable quantile sketch per source (KLL, built into Spark; its rank error at `SKETCH_K` is about 0.2 %) gives two
values that enclose the k-th best score. A pass over the rows counts what lies below and inside, which proves the
enclosure (a sketch may err; then it is widened), and narrows again while more than `LOOK` rows lie inside. Of what is
left, counted by value, the k-th best is exact, with all its ties. Nothing is sorted but those values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import bounded_rows, cut

SKETCH_K, RANK_ERROR, LOOK = 2048, 0.004, 200_000
#: Ranks asked of a sketch: 0, 1 / GRID, ..., 1.
GRID = 500


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def scored_records(df: DataFrame, sources: DataFrame, better: dict[str, str], key: str = "id", source: str = "source") -> DataFrame:
    """(key, source, badness) of each record with a finite score, once however often it was delivered.

    `sources` names each source's score field; `better` tells for each field whether "low" or "high" is better, and badness
    is lower for a better score. Rows without key or of no listed source are no records. Deliveries that differ count by
    their best score.
    """
    fields = [c for c in better if c in df.columns]
    listed = F.broadcast(sources.where(F.col(source).isNotNull()).select(F.col(source), F.col("score_field").alias("__field")).dropDuplicates([source]))
    bounded_rows(sources.select(source), 100_000, "the list of sources")
    joined = df.select(key, source, *fields).where(F.col(key).isNotNull()).join(listed, source)
    score = F.coalesce(*[F.when(F.col("__field") == c, F.col(c).cast("double") * (1.0 if better[c] == "low" else -1.0)) for c in fields]) + 0.0
    return joined.withColumn("badness", score).where(finite(F.col("badness"))).groupBy(key, source).agg(F.min("badness").alias("badness"))


def kth_best(records: DataFrame, wanted: dict, source: str = "source") -> dict:
    """Source -> (k-th least badness, rows better, rows equal). `wanted` has k for each source, 1 <= k <= its rows."""
    spark = records.sparkSession
    inside = {s: (-math.inf, math.inf, 0, None) for s in wanted}  # lo, hi, rows below lo, rows inside
    kind = records.schema[source].dataType.simpleString()
    error = RANK_ERROR

    def bracketed(open_: list) -> DataFrame:
        rows = [(s, inside[s][0], inside[s][1]) for s in open_]
        return records.join(F.broadcast(spark.createDataFrame(rows, f"{source} {kind}, lo double, hi double")), source).where("badness >= lo and badness <= hi")

    while open_ := [s for s, (lo, hi, _, n) in inside.items() if (n is None or n > LOOK) and lo < hi]:
        sketches = bracketed(open_).groupBy(source).agg(F.count("*").alias("n"), F.min("badness").alias("least"), F.max("badness").alias("most"), F.kll_sketch_agg_double("badness", F.lit(SKETCH_K)).alias("sketch"))
        rank = spark.createDataFrame([(s, float(wanted[s] - inside[s][2])) for s in open_], f"{source} {kind}, k double")
        low, high = F.col("k") / F.col("n") - error, F.col("k") / F.col("n") + error
        grid = sketches.join(F.broadcast(rank), source).withColumn("grid", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
        low_at, high_at = F.floor(low * GRID).cast("int"), F.ceil(high * GRID).cast("int")
        lo = F.when(low_at < 1, F.col("least")).otherwise(F.get("grid", F.least(low_at, F.lit(GRID))))
        hi = F.when(high_at >= GRID, F.col("most")).otherwise(F.get("grid", F.greatest(high_at, F.lit(0))))
        guess = grid.select(source, lo.alias("lo"), hi.alias("hi")).collect()
        tried = spark.createDataFrame([(r[source], r["lo"], r["hi"]) for r in guess], f"{source} {kind}, l double, h double")
        counts = bracketed(open_).join(F.broadcast(tried), source).groupBy(source, "l", "h").agg(F.count_if(F.expr("badness < l")).alias("below"), F.count_if(F.expr("badness between l and h")).alias("n")).collect()
        proved = False
        for r in counts:
            s = r[source]
            below = inside[s][2] + r["below"]
            if below < wanted[s] <= below + r["n"]:
                proved |= inside[s][3] is None or r["n"] < inside[s][3]
                inside[s] = (r["l"], r["h"], below, r["n"])
        if not proved:
            error *= 4
            if error > 1:  # no sketch helps: halve the values instead, which always narrows
                _halve(inside, wanted, bracketed, open_, source, kind)
    values = bracketed(list(inside)).groupBy(source, "badness").agg(F.count("*").alias("ties"))
    rank = spark.createDataFrame([(s, wanted[s], b[2]) for s, b in inside.items()], f"{source} {kind}, k long, below long")
    before = F.sum("ties").over(W.partitionBy(source).orderBy("badness")) - F.col("ties") + F.col("below")
    found = values.join(F.broadcast(rank), source).withColumn("better", before).where("better < k and k <= better + ties")
    return {r[source]: (r["badness"], r["better"], r["ties"]) for r in found.collect()}


def _halve(inside: dict, wanted: dict, bracketed: Callable[[list], DataFrame], open_: list, source: str, kind: str) -> None:
    """Narrow each bracket to the half of its values that holds the wanted rank, by one count."""
    middle = {s: inside[s][0] / 2 + inside[s][1] / 2 for s in open_ if all(map(math.isfinite, inside[s][:2]))}
    unbounded = [s for s in open_ if s not in middle]
    if unbounded:
        for r in bracketed(unbounded).groupBy(source).agg(F.min("badness").alias("lo"), F.max("badness").alias("hi"), F.count("*").alias("n")).collect():
            inside[r[source]] = (r["lo"], r["hi"], 0, r["n"])
    middle = {s: min(max(m, inside[s][0]), math.nextafter(inside[s][1], -math.inf)) for s, m in middle.items()}
    if not middle:
        return
    rows = bracketed(list(middle))
    at = F.broadcast(rows.sparkSession.createDataFrame(list(middle.items()), f"{source} {kind}, middle double"))
    counted = rows.join(at, source).groupBy(source).agg(F.count_if(F.col("badness") <= F.col("middle")).alias("n"), F.max(F.when(F.col("badness") <= F.col("middle"), F.col("badness"))).alias("top"), F.min(F.when(F.col("badness") > F.col("middle"), F.col("badness"))).alias("least"), F.count("*").alias("all"))
    for r in counted.collect():
        s = r[source]
        lo, hi, below, _ = inside[s]
        inside[s] = (lo, r["top"], below, r["n"]) if wanted[s] <= below + r["n"] else (r["least"], hi, below + r["n"], r["all"] - r["n"])


def cutoffs(records: DataFrame, sources: DataFrame, better: dict[str, str], source: str = "source") -> DataFrame:
    """One row per listed source with records: cutoff, records, the number to keep, really kept, and tied at the cutoff.

    `keep_pct` percent of the records are to stay, rounded up; null is taken as 100, more than 100 as 100. At 0 or less
    nothing is kept and the cutoff is null. Scores equal to the cutoff are kept, so ties may exceed the fraction.
    """
    counts = {r[source]: r["n"] for r in bounded_rows(records.groupBy(source).agg(F.count("*").alias("n")), 100_000, "the sources")}
    listed = {r[source]: r for r in bounded_rows(sources.select(source, "score_field", "keep_pct").where(F.col(source).isNotNull()).dropDuplicates([source]), 100_000, "the list of sources")}
    pct = {s: min(100, max(0, 100 if r["keep_pct"] is None else r["keep_pct"])) for s, r in listed.items()}
    wanted = {s: -(-n * pct[s] // 100) for s, n in counts.items() if s in pct}
    best = kth_best(records, {s: k for s, k in wanted.items() if k > 0}, source) if any(wanted.values()) else {}
    rows = []
    for s, k in sorted(wanted.items()):
        field = listed[s]["score_field"]
        value, less, ties = best.get(s, (None, 0, 0))
        rows.append((s, field, counts[s], pct[s], k, None if value is None else (value if better[field] == "low" else -value) + 0.0, less + ties, ties, (less + ties) / counts[s], value))
    kind = records.schema[source].dataType.simpleString()
    return records.sparkSession.createDataFrame(rows, f"{source} {kind}, score_field string, n long, keep_pct int, k long, cutoff double, n_kept long, n_ties long, kept_share double, badness_cutoff double")


def beyond_cutoff(df: DataFrame, sources: DataFrame, better: dict[str, str], key: str = "id", source: str = "source") -> DataFrame:
    """(key, source, badness) of the records that are worse than their source's cutoff."""
    records = cut(scored_records(df, sources, better, key, source))
    at = cutoffs(records, sources, better, source).select(source, "badness_cutoff")
    return records.join(F.broadcast(at), source).where(F.col("badness_cutoff").isNull() | (F.col("badness") > F.col("badness_cutoff"))).select(key, source, "badness")
