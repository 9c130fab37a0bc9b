"""Connected components of links between numbers, as joins and aggregations.

Large-star and small-star steps in turn: each number's neighbours move to the
smallest number near it, until nothing changes. Every step is one shuffle with
pre-aggregation; a hub that links to a third of all rows is a group of rows in
a hash aggregate, never a list. Nothing is collected but the number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import Stored


def components(links: DataFrame, keep: Stored, name: str) -> DataFrame:
    """v, root (the smallest number reachable) of every number in links (a, b).

    Links of a number with itself and repeated links change nothing; rows with
    a null end are left out. No links: an empty result."""
    at = keep.put(links.where("a is not null and b is not null and a != b")
                  .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}-0")
    step, last = 0, None
    while True:
        step += 1
        # large star: larger neighbours of v move to the smallest number around v
        both = at.unionByName(at.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: v and its smaller neighbours move to the smallest of those
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = keep.put(small.unionByName(least.select("v", F.col("m").alias("u"))).where("v != u").distinct(), f"{name}-{step}")
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"), F.countDistinct("v").alias("k")).first()
        keep.drop(f"{name}-{step - 1}")
        if tuple(seen) == last and seen.n == seen.k:  # every number points at one root, and nothing moved
            roots = after.select("v", F.col("u").alias("root"))
            return keep.put(roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()), f"{name}-roots")
        last, at = tuple(seen), after
