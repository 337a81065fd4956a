"""Walks over document links and category trees, by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable


def breadth_first(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, max_docs: int | None = None, max_hops: int = 100) -> DataFrame:
    """(node, hop) of all nodes reached from ``seeds`` (column node) over ``edges`` (src, dst).

    Nodes that are not in ``nodes`` cannot be parsed: they are left out and
    lead nowhere.  Each hop is one join with the frontier and one anti join
    with what was seen; written tables keep the plan short and survive
    lost executors.  With ``max_docs`` the first ones by hop, then node, are kept.
    """
    keep = (lambda df: df.join(nodes.select("node").distinct(), "node", "left_semi")) if nodes is not None else lambda df: df
    frontier = durable(keep(seeds.select("node").distinct()).withColumn("hop", F.lit(0)), "hop")
    seen = frontier
    n = seen.count()
    for hop in range(1, max_hops + 1):
        if max_docs is not None and n >= max_docs:
            break
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = durable(keep(step).join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        found = frontier.count()
        if not found:
            break
        n += found
        seen = seen.union(frontier)
    return seen if max_docs is None else seen.orderBy("hop", "node").limit(max_docs)


def category_members(listing: DataFrame, root: str, depth: int = 2, limit: int | None = None) -> DataFrame:
    """Titles under ``root``, depth first, direct members before those of subcategories.

    ``listing`` has category, member, position and is_subcat.  Depth alone
    bounds cycles; a title is kept at its first place.
    """
    pad = F.lpad(F.col("position").cast("string"), 10, "0")
    level = listing.where(F.col("category") == root).select("member", "is_subcat", F.concat(F.when(F.col("is_subcat"), "1").otherwise("0"), pad).alias("path"))
    titles = level.where("not is_subcat").select("member", "path")
    for _ in range(depth):
        subs = level.where("is_subcat").select(F.col("member").alias("category"), F.col("path").alias("above"))
        level = listing.join(subs, "category").select("member", "is_subcat", F.concat("above", F.when(F.col("is_subcat"), "1").otherwise("0"), pad).alias("path"))
        titles = titles.union(level.where("not is_subcat").select("member", "path"))
    out = titles.groupBy("member").agg(F.min("path").alias("path"))
    return (out.orderBy("path").limit(limit) if limit else out).select("member", "path")
