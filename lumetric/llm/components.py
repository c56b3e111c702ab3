"""Connected components of a link table, by star contraction over stored tables.

Every round is two shuffles of the links that are left. No link list, label or
component is ever gathered in one place, and a vertex with very many links is
no problem: the larger neighbours of a vertex are linked to its smallest one
through a grouped minimum and a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path


def _stored(df: DataFrame, owner: str, label: str) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession, owner, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(links: DataFrame, owner: str, rounds: int = 60) -> DataFrame:
    """links: a, b (bigint). Returns v and root, the smallest vertex reachable.

    Vertices without a link don't appear. Each round hooks every vertex to the
    smallest label around it and then halves the paths of the label forest, so
    the number of rounds is logarithmic in practice; the loop ends when a round
    changes nothing and raises if that doesn't come in `rounds`.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select("a", "b")
    both, _ = _stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), owner, "links")
    labels, path = _stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), owner, "labels")
    for _ in range(rounds):
        # the smallest label next to each label's members
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        hook = (
            labels.join(seen, "v").groupBy("root").agg(F.min("near").alias("near"))
            .select(F.col("root"), F.least("root", "near").alias("up"))
        )
        hook, hook_path = _stored(hook, owner, "hooks")
        # two steps up the forest of labels
        far = hook.select(F.col("root").alias("up"), F.col("up").alias("upper"))
        jump = hook.join(far, "up", "left").select("root", F.coalesce("upper", "up").alias("up"))
        moved = labels.join(jump, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
        new, new_path = _stored(moved, owner, "labels")
        changed = hook.where("up <> root").limit(1).count()
        remove(spark, path)
        remove(spark, hook_path)
        labels, path = new, new_path
        if not changed:
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def extended(labels: DataFrame, links: DataFrame, owner: str) -> DataFrame:
    """labels (v and root, as of `components`) once more links (a, b) hold. Only the components
    that these join are labelled anew, each as one vertex, so the links before aren't read again.
    Where nothing is joined, labels itself is returned."""
    ends = links.select("a", "b")
    for side in "ab":
        of = labels.select(F.col("v").alias(side), F.col("root").alias(f"root_{side}"))
        ends = ends.join(of, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    joined, path = _stored(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b").distinct(), owner, "joined")
    if not joined.limit(1).count():
        return labels
    tops = components(joined, owner)
    up = tops.select(F.col("v").alias("root"), F.col("root").alias("up"))
    moved = labels.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
    out, _ = _stored(moved.unionByName(tops.join(labels.select("v"), "v", "left_anti")), owner, "labels")
    remove(labels.sparkSession, path)
    return out
