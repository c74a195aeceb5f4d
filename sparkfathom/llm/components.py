"""Connected components of a distributed graph by contraction.

Each round every component hooks onto its smallest neighbour, pointers are
followed to their roots by doubling, and edges are contracted. Vertices, edges
and labels stay distributed; each step is a written table, so lineage is short
and nothing depends on one executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm import shared


def follow(pointers: DataFrame) -> DataFrame:
    """``(node, parent)`` with each parent replaced by its root.

    Parents are smaller than their nodes or equal, so there are no cycles and
    doubling ends after about the logarithm of the depth.
    """
    while True:
        to = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = shared.materialise(
            pointers.join(to, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                (F.col("grand") != F.col("parent")).alias("moved"),
            ),
            "cc-jump",
        )
        shared.discard(pointers)
        pointers = jumped.drop("moved")
        pointers._scratch_path = jumped._scratch_path
        if not jumped.where("moved").count():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every vertex of ``edges(a, b)``; comp is the smallest vertex.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    work = shared.materialise(edges.where("a != b").select("a", "b").distinct(), "cc-edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = shared.materialise(ends.withColumn("comp", F.col("node")), "cc-labels")
    while work.count():
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least"))
        pointers = hooks.select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))
        roots = follow(shared.materialise(pointers, "cc-hooks"))
        of = lambda name: roots.select(F.col("node").alias(name), F.col("parent").alias(f"{name}_root"))
        before, edges_before = labels, work
        labels = shared.materialise(
            labels.join(of("comp"), "comp", "left").select("node", F.coalesce("comp_root", "comp").alias("comp")),
            "cc-labels",
        )
        work = shared.materialise(
            work.join(of("a"), "a")
            .join(of("b"), "b")
            .where("a_root != b_root")
            .select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            .distinct(),
            "cc-edges",
        )
        shared.discard(before, edges_before, roots)
    shared.discard(work)
    return labels
