"""PageRank over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.hashing import hash_key
from tarnweave.plans.index import indexable
from tarnweave.session import bucketed, release

DAMPING = 0.85


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst): pages with url and page, and their different out-links, crawled or not."""
    nodes = indexable(pages).select(F.col("key").alias("id"))
    links = indexable(pages).where("urls is not null").select(F.col("key").alias("src"), F.explode(F.array_distinct("urls")).alias("url"))
    return nodes, links.where("url is not null").select("src", hash_key("url").alias("dst"))


def pagerank(nodes: DataFrame, edges: DataFrame, threshold: float | None = 0.01, rounds: int | None = None) -> DataFrame:
    """id, rank. All ranks begin at 1; new(v) = 0.15 + sum of 0.85 * rank(u) / outdegree(u) over edges u -> v.

    Out-degrees count links to pages that were not crawled; what would flow there is lost, as is the mass of pages
    without links; ranks are not normalised. Ends once no rank moves by `threshold` or more, after at least one round,
    or after `rounds` rounds; with a threshold above 0 it always ends, as every round moves the ranks less by the damping.
    Edges keep only those between nodes, with their share, and lie in buckets by source, as the ranks do by node: a round
    joins them without a shuffle, and sums partial sums that are made before one, so a page that all link to is no hot
    key. Each round's ranks are a table in the shared folder; all but the last are deleted.
    """
    if rounds is None and not (threshold and threshold > 0):
        raise ValueError("a threshold above 0, or a number of rounds")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    inner = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    shares = bucketed(inner.join(degree, "src").select("src", "dst", (F.lit(DAMPING) / F.col("degree")).alias("share")), "src", "edges")
    state = bucketed(nodes.distinct().select("id", F.lit(1.0).alias("rank")), "id", "ranks")
    done = 0
    while True:
        incoming = shares.join(state, shares["src"] == state["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = state.join(incoming, state["id"] == incoming["dst"], "left").select("id", (F.coalesce("in", F.lit(0.0)) + (1 - DAMPING)).alias("rank"), F.abs(F.coalesce("in", F.lit(0.0)) + (1 - DAMPING) - F.col("rank")).alias("moved"))
        new = bucketed(new, "id", "ranks")
        done += 1
        moved = new.agg(F.max("moved")).first()[0] or 0.0 if rounds is None else None
        release(state)
        kept = new.select("id", "rank")
        kept._tarnweave_path, kept._tarnweave_table = new._tarnweave_path, new._tarnweave_table
        state = kept
        if done == rounds or rounds is None and moved < threshold:
            release(shares)
            return state
