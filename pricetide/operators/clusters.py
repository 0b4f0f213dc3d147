"""Grouping of like products, representatives, and merging of catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import similarity
from pricetide.session import checkpointed


def title_edges(items: DataFrame, least: float = 0.65) -> DataFrame:
    """lo, hi of items of one brand and category whose titles are similar.

    ``items`` has pos, title, brand, category.  Equal titles are merged first and
    only distinct titles of lengths that can reach ``least`` are compared; an
    item is linked to the first item of its own title, and first items to each
    other.  Every link between different texts is kept.
    """
    titled = items.where("brand is not null and category is not null and title is not null")
    groups = titled.groupBy("brand", "category", "title").agg(F.min("pos").alias("pos"))
    width = F.lit(8)
    a = groups.select("brand", "category", F.col("title").alias("t"), F.col("pos").alias("p"), F.floor(F.length("title") / width).alias("band"))
    # a title of length n can match lengths n*least to n/least: send the shorter side to every band it can reach
    reach = F.sequence(F.col("band"), F.floor(F.length("t") / F.lit(least) / width))
    b = a.withColumn("band", F.explode(reach)).select("brand", "category", "band", F.col("t").alias("u"), F.col("p").alias("q"))
    pairs = a.join(b, ["brand", "category", "band"]).where((F.length("u") < F.length("t")) | ((F.length("u") == F.length("t")) & (F.col("u") < F.col("t"))))
    near = pairs.where(similarity(F.col("t"), F.col("u")) >= least).select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    copies = titled.join(groups.withColumnRenamed("pos", "lo"), ["brand", "category", "title"]).where("pos > lo").select("lo", F.col("pos").alias("hi"))
    return near.unionByName(copies).distinct()


def chip_edges(items: DataFrame, chips: tuple[str, ...] = ("gpu", "cpu")) -> DataFrame:
    """lo, hi of items that are not of one brand and category but state the same chip.

    ``items`` has pos, brand, category and the columns ``chips``.  Every pair is named: the greedy pass may take the
    first item of a chip from the others, which are then still linked to each other.
    """
    result = None
    for chip in chips:
        stated = items.where((F.col(chip) != "") & F.col("pos").isNotNull()).select(F.col(chip).alias("chip"), "pos", "brand", "category")
        later = stated.select("chip", F.col("pos").alias("hi"), F.col("brand").alias("b"), F.col("category").alias("c"))
        one_kind = F.coalesce((F.col("brand") == F.col("b")) & (F.col("brand") != ""), F.lit(False)) & F.col("category").eqNullSafe(F.col("c"))
        pairs = stated.join(later, "chip").where((F.col("pos") < F.col("hi")) & ~one_kind).select(F.col("pos").alias("lo"), "hi")
        result = pairs if result is None else result.unionByName(pairs)
    return result.distinct()


def greedy_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, seed of each node, as a greedy pass in order of pos would give.

    The pass makes the first unused node a seed and gives it every unused later
    node that is linked to it.  Its seeds are the first independent set in order
    of pos, and a node belongs to its first linked seed.  That set is found in
    rounds over the whole graph: a node that no earlier undecided node is linked
    to becomes a seed, and what is linked to a seed is decided.  ``nodes`` has
    pos; ``edges`` has lo < hi.
    """
    edges = checkpointed(edges.select("lo", "hi").distinct())
    undecided = checkpointed(nodes.select("pos").distinct())
    open_edges = edges
    seeds = None
    while not undecided.isEmpty():
        blocked = open_edges.select(F.col("hi").alias("pos")).distinct()
        new = checkpointed(undecided.join(blocked, "pos", "left_anti"))
        seeds = new if seeds is None else seeds.unionByName(new)
        taken = open_edges.join(new.withColumnRenamed("pos", "lo"), "lo", "left_semi").select(F.col("hi").alias("pos")).distinct()
        undecided = checkpointed(undecided.join(new, "pos", "left_anti").join(taken, "pos", "left_anti"))
        left = undecided.withColumnRenamed("pos", "lo")
        open_edges = checkpointed(open_edges.join(left, "lo", "left_semi").join(left.withColumnRenamed("lo", "hi"), "hi", "left_semi"))
    if seeds is None:
        return nodes.select("pos", F.col("pos").alias("seed"))
    member = edges.join(seeds.withColumnRenamed("pos", "lo"), "lo", "left_semi").groupBy(F.col("hi").alias("pos")).agg(F.min("lo").alias("seed"))
    own = seeds.select("pos", F.col("pos").alias("seed"))
    return own.unionByName(member.join(seeds, "pos", "left_anti"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, component: the smallest node that each node is connected with.

    Labels travel along links and jump to the label of their label, so rounds
    grow with the logarithm of the diameter; each round is checkpointed.
    """
    both = checkpointed(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"))).distinct())
    labels = checkpointed(nodes.select("pos", F.col("pos").alias("label")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("pos", "b"), "b").groupBy(F.col("a").alias("pos")).agg(F.min("label").alias("m"))
        stepped = labels.join(near, "pos", "left").select("pos", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        jumped = stepped.join(labels.select(F.col("pos").alias("next"), F.col("label").alias("far")), "next", "left")
        new = checkpointed(jumped.select("pos", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        if new.where("next <> label").isEmpty():
            return new.select("pos", F.col("label").alias("component"))
        labels = new.select("pos", F.col("next").alias("label"))


def representative(df: DataFrame, key: str, score: Column, order: list[str], largest: bool = True) -> DataFrame:
    """One row per key: the one with the best score, the first in order of equals; by partial aggregation."""
    scored = df.withColumn("_score", -score if largest else score)
    rest = [c for c in df.columns if c not in (key, *order)]
    best = scored.groupBy(key).agg(F.min(F.struct("_score", *order, *rest)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def merged_specs(df: DataFrame, key: str, specs: str, order: str) -> DataFrame:
    """key, spec_key, spec_value: of each specification the first value that isn't null or empty."""
    pairs = df.select(key, order, F.explode(specs).alias("spec_key", "spec_value")).where("spec_value is not null and spec_value <> ''")
    return pairs.groupBy(key, "spec_key").agg(F.min(F.struct(order, "spec_value")).alias("f")).select(key, "spec_key", F.col("f.spec_value").alias("spec_value"))


def anti_merge(base: DataFrame, incoming: DataFrame, key: Column, order: str) -> DataFrame:
    """The base with the incoming rows whose key it lacks, each key once."""
    known = base.select(key.alias("_k")).where("_k is not null").distinct()
    new = incoming.withColumn("_k", key)
    rest = [c for c in incoming.columns if c != order]
    first = new.groupBy("_k").agg(F.min(F.struct(order, *rest)).alias("r")).join(known, "_k", "left_anti")
    return base.unionByName(first.select("r.*").select(*base.columns))


def replace_source(base: DataFrame, incoming: DataFrame, is_source: Column) -> DataFrame:
    """The base without the rows of a source, with the incoming rows instead."""
    return base.where(~F.coalesce(is_source, F.lit(False))).unionByName(incoming.select(*base.columns))


def best_match(left: DataFrame, right: DataFrame, block: list[str], score: Column, left_id: str, right_id: str, least: float) -> DataFrame:
    """For each row of the left side the right row of its block with the highest score from ``least`` on; the smaller id of equals."""
    pairs = left.join(right, block).select(left_id, right_id, score.alias("score")).where(F.col("score") >= least)
    best = pairs.groupBy(left_id).agg(F.max(F.struct("score", (-F.col(right_id)).alias("n"))).alias("b"))
    return best.select(left_id, (-F.col("b.n")).alias(right_id), F.col("b.score").alias("score"))
