"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a few joins and aggregations over the links and ends in a written table, so lineage
stays short and a lost executor costs a re-read; the table of the round before is deleted then. A node of very high degree is pre-aggregated before
its shuffle, and its links are joined in SALTS shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, saved

SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with the least neighbour m of u; the links of one u lie in SALTS shares."""
    shares = least.withColumn("share", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    return links.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(shares, ["u", "share"])


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node that occurs in links (a, b); root is the least node reachable.

    Links may repeat, be reversed or join a node to itself; an empty table gives an empty result. Rounds grow with
    the logarithm of the longest path; if `rounds` of them don't do, it raises an error and gives no result.
    """
    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        """The table, and what tells whether it has changed: its rows' number and the sum of their hashes."""
        seen = Observation()
        table = saved(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        return table, (seen.get["n"], seen.get["h"])

    pairs, state = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds if state[0] else 0):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, (pairs, now) = pairs, written(small.union(least.select("u", "m")).distinct())
        discard(before)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components aren't final after {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select("v", "v").distinct()
    )


def verified_groups(
    nodes: DataFrame, propose: Callable[[DataFrame, bool], DataFrame], check: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame | None:
    """(node, root) of all nodes with a verified link; None if there are none.

    nodes: node, in one row or several, and what `propose` needs. propose(nodes with root, whole) gives pairs (a, b) of
    nodes of different roots: a few for each node at first, which merge most of what belongs together, then (whole)
    every one that can be a link. check(pairs) gives (a, b, ok). So each possible link either is checked or lies in one
    group anyway, and none is lost. rest(nodes with root), where it is given, takes the place of the second turn: it gives
    the verified links (a, b) themselves, as many as join what belongs together.
    """
    links, found, refuted = None, None, None
    for whole in (False, True):
        rooted = nodes.withColumn("root", F.col("node"))
        if found is not None:
            rooted = saved(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        if whole and rest:
            new = saved(rest(rooted), "rest")
        else:
            pairs = propose(rooted, whole)
            pairs = pairs if refuted is None else pairs.join(refuted, ["a", "b"], "left_anti")
            checked = saved(check(saved(pairs, "pairs")), "checked")
            new, refuted = checked.filter("ok").select("a", "b"), checked.filter("not ok").select("a", "b")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            found = saved(components(links), "groups")
    return found


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with ok: whether the sets (node, shingles) of both have the Jaccard similarity."""
    one, other = sets.toDF("a", "s"), sets.toDF("b", "t")
    both = F.size(F.array_intersect("s", "t"))
    ok = both >= similarity * (F.size("s") + F.size("t") - both) - 1e-9
    return pairs.join(one, "a").join(other, "b").select("a", "b", ok.alias("ok"))
