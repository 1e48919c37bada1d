"""Walks over links and sitemaps, frontier by frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int, most: int | None = None) -> DataFrame:
    """(node, depth) of the nodes within ``max_depth`` links of the seeds (node), each at its least depth.

    ``edges`` has (src, dst). With ``most``, only the first nodes by depth and name are kept. Each frontier is
    joined with the edges and freed of visited nodes; its lineage is cut in the shared folder.
    """
    frontier = cut(seeds.where("node is not null").select("node").distinct())
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
        frontier = cut(step.join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return visited if most is None else visited.orderBy("depth", "node").limit(most)


def spider(edges: DataFrame, seeds: DataFrame, max_fetches: int, max_depth: int, is_goal: Column) -> DataFrame:
    """The goal nodes among ``seeds``' neighbourhood when at most ``max_fetches`` nodes are opened, in name order.

    Nodes are opened by depth and name, so the cut is the same in every run.
    """
    near = reached(edges, seeds, max_depth)
    opened = near.orderBy("depth", "node").limit(max_fetches).select(F.col("node").alias("src"))
    found = opened.join(edges, "src").select(F.col("dst").alias("node")).unionByName(seeds.select("node")).where("node is not null").distinct()
    return found.where(is_goal).select("node").orderBy("node")


def sitemap_leaves(locations: DataFrame, starts: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(loc) of all leaves that an index (url, is_index, pos, loc) leads to from ``starts`` (url), each once."""
    children = locations.where("is_index").select(F.col("url").alias("src"), F.col("loc").alias("dst"))
    maps = reached(children, starts.select(F.col("url").alias("node")), max_rounds).select(F.col("node").alias("url"))
    return locations.where("not is_index").join(maps, "url", "left_semi").select("loc").distinct()


def sitemap_products(locations: DataFrame, starts: DataFrame, max_sitemaps: int = 100, max_rounds: int = 8) -> DataFrame:
    """(site, place, url): the product pages that each site's sitemaps lead to, in the order in which a walk finds them.

    ``locations`` has (url, is_index, pos, loc). Only places of the site itself are followed and kept; addresses are
    in canonical form. Of a site at most ``max_sitemaps`` files are opened, by depth and name, so a walk ends whatever
    its files say; sitemaps and pages that come again count once.
    """
    within = locations.select(U.canonical(F.col("url")).alias("url"), "is_index", "pos", U.canonical(F.col("loc")).alias("loc"), U.site_of(F.col("url")).alias("site")).where(U.site_of(F.col("loc")) == F.col("site"))
    children = within.where("is_index").select(F.col("url").alias("src"), F.col("loc").alias("dst"))
    maps = reached(children, starts.select(U.canonical(F.col("url")).alias("node")), max_rounds)
    nth = F.row_number().over(Window.partitionBy("site").orderBy("depth", "url"))  # a site's files, not its pages
    opened = maps.select(F.col("node").alias("url"), "depth", U.site_of(F.col("node")).alias("site")).withColumn("nth", nth).where(F.col("nth") <= max_sitemaps)
    leaves = within.where(~F.col("is_index") & U.is_product(F.col("loc"))).join(opened.select("url", "nth"), "url")
    return leaves.groupBy("site", F.col("loc").alias("url")).agg(F.min(F.struct("nth", "pos")).alias("place"))


def in_order(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its rank within all rows; meant for results that are small by nature."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
