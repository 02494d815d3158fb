"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the least of each node's neighbourhood: the larger ones, or the smaller ones and the node."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = near.join(least, "a")
    hung = hung.where("b > a") if larger else hung.unionByName(least.select("a", F.col("a").alias("b"), "m"))
    return hung.where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on one node: edges(a, b) with a < b are then stars around least nodes."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("centre").alias("c")).where("h > 1 or (h = 1 and c = 1)").isEmpty()


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges(a, b) -> (node, label): the least node of each component, for every node that has an edge.

    Each round's edges are a table in the shared folder; the loop ends when every component is a star around its least node.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    while not _stars(edges):
        edges = materialize(_star(_star(edges, True), False), tag)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
