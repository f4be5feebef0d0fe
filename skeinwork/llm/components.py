"""Connected components of an edge table, by repeated contraction; nothing is collected."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): for each end of an edge the least id of its component. Loops and repeated edges do no harm; no edges, no rows.

    In each round every node takes the first of itself and its neighbours, in an order that changes with the round, and
    edges are drawn anew between what their ends took. Edges within a group vanish, so rounds get smaller by a constant
    share, whatever the paths. A node with many neighbours only ever takes part in joins and in a minimum.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = materialise(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    masks = np.random.Generator(np.random.PCG64(17))
    labels = None
    while pairs.limit(1).count():
        mask = F.lit(int(masks.integers(0, 2**63)))
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
        first = F.least(F.min(F.col("other").bitwiseXOR(mask)), F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask)
        taken = materialise(both.groupBy("id").agg(first.alias("took")), "taken")
        if labels is None:
            labels = taken.select("id", F.col("took").alias("label"))
        else:
            step = taken.select(F.col("id").alias("label"), "took")
            labels = materialise(labels.join(step, "label", "left").select("id", F.coalesce("took", "label").alias("label")), "labels")
        mine, theirs = taken.select(F.col("id").alias("a"), F.col("took").alias("x")), taken.select(F.col("id").alias("b"), F.col("took").alias("y"))
        drawn = pairs.join(mine, "a").join(theirs, "b").filter("x <> y")
        pairs = materialise(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    alone = ends.filter("a = b").select(F.col("a").alias("id")).distinct()
    if labels is None:
        return alone.select("id", F.col("id").alias("label"))
    low = labels.groupBy("label").agg(F.min("id").alias("low"))
    named = labels.join(low, "label").select("id", F.col("low").alias("label"))
    return named.unionByName(alone.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label")))
