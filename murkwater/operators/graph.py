"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folder import written


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes that edges connect have one root, a node among them.

    In each round every label that has a smaller neighbour hangs on the least one; these links form trees, which
    pointer jumping flattens in as many steps as the logarithm of their height. Then labels take on the names of
    their trees' roots and edges between labels are made anew, until none is left. Rounds are grouped minima and
    equi-joins, each written once; least neighbours are found before the shuffle as far as a task can tell. Loops
    and repeated edges do no harm; an edge with a null end is left out.
    """
    ends = edges.where("a is not null and b is not null").select("a", "b")
    labels = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("root", F.col("node"))
    now = written(ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    while not now.isEmpty():
        hooks = _flat(written(now.groupBy(F.col("hi").alias("root")).agg(F.min("lo").alias("to")), "hooks"))
        labels = written(labels.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        for end in ("lo", "hi"):
            hook = hooks.select(F.col("root").alias(end), "to")
            now = now.join(hook, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        now = written(now.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")
    return labels


def _flat(hooks: DataFrame) -> DataFrame:
    """Links (root, to) to smaller labels, led on to where no link goes on."""
    while True:
        onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
        further = written(hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")), "hooks")
        hooks = further.select("root", "to")
        if not further.where("more").limit(1).count():
            return hooks
