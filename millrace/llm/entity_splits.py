"""Splits that keep related records together.

Records and the entities they name form a bipartite graph; its connected components are the groups that must stay in one
split. Labels run over the graph by minimum: a record takes the least label of its entities, an entity the least label of
its records, and each round also hooks the label an entity had before and jumps to the label of the label, so a chain of
n links takes about log n rounds. A record that names one entity joins nothing, so only records with two or more
entities (links, co-authors) enter the rounds; the large table of records meets the result in a single join. A hub that many links name, and the label
that a large component shares, are hot keys of the rounds: their rows are joined by broadcast.

Components few enough are broadcast to the rows. Otherwise rows that name nobody are set apart before the join, and as one entity
may hold a third of the others, they are spread over `SALTS` parts of their entity and the components repeated in each.

Groups are then assigned to splits so that each label keeps its target share in each split. A group above 1/`ITEMS` of
all rows (at most `ITEMS` of them can exist) is an item of its own; all smaller groups fall by hash into `ITEMS` buckets.
The driver sees only these at most 2 x `ITEMS` items, each with a vector of label counts, and gives them out, largest first,
to the split whose deviation shrinks most. Up to `CELLS` labels have a place of their own in the vector; more labels
share the places, each with a sign (a count sketch), which keeps the expected squared deviation over all labels. So no
label is left out, however many there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import BROADCAST_BYTES, bounded_rows, cut, drop

ITEMS, CELLS, SALTS = 2048, 256, 32
#: An entity with more links, or a label with more entities, is joined by broadcast; there are at most all / HOT.
HOT = 1_000_000


def entity_key(name: Column) -> Column:
    """An entity id without white space (any Unicode white space) and case; null where it names nobody: null, blank, or `unknown` after its last colon."""
    key = F.lower(F.upper(F.regexp_replace(name.cast("string"), r"(?U)\s+", "")))
    return F.when((key != "") & ~key.rlike("(^|:)unknown$"), key)


def _hot(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """The values of `key` with more than `HOT` of the n rows, at most n / HOT of them; None if there can be none."""
    if n <= HOT:
        return None
    return F.broadcast(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT).select(key))


def _join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join to a table of unique keys; the rows of hot keys stay where they are and get theirs by broadcast."""
    if hot is None:
        return left.join(right, key)
    few = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return few.unionByName(left.join(hot, key, "left_anti").join(right, key))


def components(edges: DataFrame) -> DataFrame:
    """(entity, component) of the bipartite graph with edges (record, entity): component is the least entity reached. Nulls relate nothing; repeated and self-referring records are harmless; no edges give no rows."""
    edges = edges.where("record is not null and entity is not null").select("record", "entity").distinct()
    several = edges.groupBy("record").count().where("count > 1").select("record")
    edges = cut(edges.join(several, "record", "left_semi"))
    labels = state = cut(edges.select("entity", F.col("entity").alias("label")).distinct())
    n_edges, n_labels = edges.count(), labels.count()
    hubs = _hot(edges, "entity", n_edges)
    while True:
        by_record = _join_unique(edges, labels, "entity", hubs).groupBy("record").agg(F.min("label").alias("label"))
        by_entity = edges.join(by_record, "record").groupBy("entity").agg(F.min("label").alias("least"))
        met = labels.join(by_entity, "entity").select("entity", "label", "least")
        hooked = met.select("entity", "least").union(met.select(F.col("label").alias("entity"), "least")).groupBy("entity").agg(F.min("least").alias("least"))
        up = hooked.select(F.col("entity").alias("least"), F.col("least").alias("top"))
        jumped = _join_unique(hooked, up, "least", _hot(hooked, "least", n_labels)).select("entity", F.least("least", "top").alias("new"))
        before, state = state, cut(labels.join(jumped, "entity").select("entity", "label", "new"))
        drop(before)
        labels = state.select("entity", F.col("new").alias("label"))
        if not state.where("label <> new").limit(1).count():
            drop(edges)
            return labels.withColumnRenamed("label", "component")


def with_groups(df: DataFrame, entity: str, links: DataFrame, left: str, right: str, link_key: str, key: Column, out: str = "group") -> DataFrame:
    """`df` with the group of each row: the component of its entity, or where it names nobody the value of `key`.

    `links` states that two entities are one; `link_key` tells its rows apart.
    """
    edges = links.select(F.col(link_key).alias("record"), F.explode(F.array(entity_key(F.col(left)), entity_key(F.col(right)))).alias("entity"))
    of = components(edges).select(F.col("entity").alias("__entity"), F.col("component").alias("__component"))
    keyed = df.withColumn("__entity", entity_key(F.col(entity)))
    own = F.concat(F.lit("e:"), F.coalesce("__component", "__entity"))
    # measured, as the optimizer's estimate grows with the rounds that made the table
    held = of.agg(F.sum(F.octet_length("__entity") + F.octet_length("__component") + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        # no row moves, so no entity can be too frequent
        return keyed.join(F.broadcast(of), "__entity", "left").withColumn(out, F.coalesce(own, F.concat(F.lit("r:"), key))).drop("__entity", "__component")
    nobody = keyed.where("__entity is null").withColumn(out, F.concat(F.lit("r:"), key))
    salted = of.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = keyed.where("__entity is not null").withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    joined = named.join(salted, ["__entity", "__salt"], "left").withColumn(out, own)
    return joined.drop("__entity", "__component", "__salt").unionByName(nobody.drop("__entity"))


def assign(names: list[str], sizes: np.ndarray, vectors: np.ndarray, shares: dict[str, float]) -> dict[str, str]:
    """Item -> split. Items with their rows and vectors (label counts by the root of the label's total, or a sketch of them) go largest first to the split after which the squared deviation from the targets is least, over labels and over all rows (ties: larger share, then name)."""
    splits = sorted(shares)
    share = np.array([shares[s] for s in splits])
    total = max(float(sizes.sum()), 1.0)
    gap = -np.outer(share, vectors.sum(axis=0))
    over = -share * total
    out = {}
    for i in sorted(range(len(names)), key=lambda i: (-sizes[i], names[i])):
        v, n = vectors[i], float(sizes[i])
        # growth of the squared deviation if the item goes to each split
        cost = (2 * gap @ v + v @ v) / total + (2 * over * n + n * n) / (total * total)
        best = min(range(len(splits)), key=lambda s: (cost[s], -share[s], splits[s]))
        gap[best] += v
        over[best] += n
        out[names[i]] = splits[best]
    return out


def grouped_split(df: DataFrame, group: str, label: str, targets: DataFrame, seed: int = 7, out: str = "new_split") -> DataFrame:
    """`df` with a split for each row: rows of one group share it, and each label (null counts as one) is spread by the target shares.

    `targets` (split, target_share): shares are scaled to sum to 1; null or non-positive ones are left out. A null group is a group of its own.
    """
    shares = {r["split"]: float(r["target_share"]) for r in bounded_rows(targets, 100, "targets") if r["split"] is not None and (r["target_share"] or 0) > 0}
    if not shares:
        raise ValueError("no split has a positive share")
    shares = {s: x / sum(shares.values()) for s, x in shares.items()}
    group_of = F.coalesce(F.col(group), F.lit(""))
    label_of = F.coalesce(F.col(label).cast("string"), F.lit(""))
    counts = cut(df.groupBy(group_of.alias("g"), label_of.alias("l")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    big = counts.groupBy("g").agg(F.sum("n").alias("size")).where(F.col("size") > total / ITEMS).select("g")
    big_names = sorted(r["g"] for r in bounded_rows(big, ITEMS, "the list of large groups"))
    spark = df.sparkSession
    listed = F.broadcast(spark.createDataFrame([(g,) for g in big_names], "g string").withColumn("__big", F.lit(True)))

    def bucket(c: Column) -> Column:
        return F.concat(F.lit("b"), F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(ITEMS)).cast("string"))

    # small groups shrink to buckets before their labels are weighed
    items = counts.join(listed, "g", "left").select(F.when(F.col("__big"), F.concat(F.lit("g"), "g")).otherwise(bucket(F.col("g"))).alias("item"), "l", "n").groupBy("item", "l").agg(F.sum("n").alias("n"))
    labels = cut(counts.groupBy("l").agg(F.sum("n").alias("all")))
    few = labels.limit(CELLS + 1).count() <= CELLS
    if few:
        places = {r["l"]: i for i, r in enumerate(sorted(labels.collect(), key=lambda r: r["l"]))}
        cells = spark.createDataFrame(list(places.items()), "l string, cell int")
        weighed = items.join(F.broadcast(labels), "l").join(F.broadcast(cells), "l").withColumn("x", F.col("n") / F.sqrt("all"))
    else:
        sign = F.when(F.pmod(F.xxhash64("l", F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        weighed = items.join(labels, "l").withColumn("cell", F.pmod(F.xxhash64("l", F.lit(seed + 2)), F.lit(CELLS)).cast("int")).withColumn("x", sign * F.col("n") / F.sqrt("all"))
    # at most 2 x ITEMS x CELLS numbers
    table = weighed.groupBy("item", "cell").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    names = sorted(set(table["item"]))
    at = {x: i for i, x in enumerate(names)}
    rows = table["item"].map(at).to_numpy(dtype=int)
    vectors, sizes = np.zeros((len(names), CELLS)), np.zeros(len(names))
    np.add.at(vectors, (rows, table["cell"].to_numpy(dtype=int)), table["x"].to_numpy(dtype=float))
    np.add.at(sizes, rows, table["n"].to_numpy(dtype=float))
    given = assign(names, sizes, vectors, shares)
    for used in (counts, labels):
        drop(used)
    of_item = F.broadcast(spark.createDataFrame(sorted(given.items()), "__item string, __s string"))
    out_df = df.withColumn("__g", group_of).join(listed.withColumnRenamed("g", "__g"), "__g", "left")
    out_df = out_df.withColumn("__item", F.when(F.col("__big"), F.concat(F.lit("g"), "__g")).otherwise(bucket(F.col("__g")))).drop("__big")
    return out_df.join(of_item, "__item", "left").withColumn(out, F.col("__s")).drop("__g", "__item", "__s")
