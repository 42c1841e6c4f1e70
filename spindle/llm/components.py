"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.session import discard, materialise


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the smallest node of its component.

    Each round hands on the smallest label along links and then follows labels once more, so rounds grow with the
    logarithm of the longest path. Every round's table is written to the shared folder; links and labels never leave
    the executors. Null ends are ignored; repeated links and links of a node with itself change nothing.
    """
    pair = links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    both = materialise(pair.union(pair.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("further"))
        after = moved.join(jump, F.col("root") == F.col("via"), "left").select("node", "old", F.coalesce(F.least("root", "further"), "root").alias("root"))
        after = materialise(after, "labels")
        changed = after.where("root <> old").limit(1).count()
        if not changed:
            discard(both)
            discard(after)
            return labels
        discard(labels)
        after_path = after._spindle_path
        labels = after.drop("old")
        labels._spindle_path = after_path
