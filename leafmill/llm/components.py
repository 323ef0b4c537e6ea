"""Connected components of a graph of links, by alternating large and small stars.

Nodes without a link don't appear. Each step keeps the components and pulls links towards the
least node of a neighbourhood; hubs are met by joins on a minimum, never gathered in a list.
Loops and repeated links are harmless; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step over links(u, v), u > v: large stars look at both ends, small ones at lesser ends."""
    near = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = near.join(least, "u")
    if small:
        ends = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        ends = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ends.filter("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links(a, b) -> node, root: the least node that is reachable, for every node with a link."""
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = materialize(pairs, name)
    before = mark(pairs)
    while before[0]:
        pairs = materialize(_stars(_stars(pairs, small=False), small=True), name)
        if (now := mark(pairs)) == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
