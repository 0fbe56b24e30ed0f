"""Problem 3: one group identifier for every record that pairwise matches link, directly or through others.

Minimum labels travel along the edges, pointer jumping flattens the label trees, and every round is cut with a
checkpoint in the shared folder. After each round the edges are contracted to the labels of their ends, so the
work shrinks; the loop ends when no edge joins two labels any more, that is when no label changes.

Defined results: pairs with a null end, self-pairs, repeated and reversed pairs are no links of their own; an empty
input gives an empty result; labels are the smallest key of the group in code point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def links(sets: DataFrame, members: Column) -> DataFrame:
    """(a, b) pairs that link all members of each row's array: a star around the smallest, a < b, distinct."""
    clean = F.array_sort(F.array_distinct(F.filter(members, lambda m: m.isNotNull())))
    return (
        sets.select(clean.alias("_m"))
        .where(F.size("_m") > 1)
        .select(F.col("_m")[0].alias("a"), F.explode(F.slice("_m", 2, F.size("_m") - 1)).alias("b"))
        .distinct()
    )


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): one row for each record of pairs that is linked to another one.

    A hub costs no more than its edges: minima are combined before the shuffle, and the joins by label have one
    row a label on their other side, so that adaptive execution can split a hot label's edges.
    """
    edges = cut(
        pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        hooks = cut(_flatten(_smallest_neighbour(edges)))
        labels = cut(_relabel(labels, hooks, "label"))
        ends = _relabel(_relabel(edges, hooks, "a"), hooks, "b")
        edges = cut(
            ends.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    return labels


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """(k, v): the smallest label among each label and its neighbours, where that is another one."""
    return edges.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("v"))


def _flatten(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: v becomes the v of v until nothing moves; hooks always lead to smaller keys, so it ends."""
    hooks = cut(hooks)
    while True:
        above = hooks.select(F.col("k").alias("_k"), F.col("v").alias("_v"))
        jumped = cut(
            hooks.join(above, F.col("v") == F.col("_k"), "left").select(
                "k", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved")
            )
        )
        if jumped.where("moved").isEmpty():
            return jumped.select("k", "v")
        hooks = jumped.select("k", "v")


def _relabel(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    joined = rows.join(hooks, F.col(column) == F.col("k"), "left")
    return joined.withColumn(column, F.coalesce("v", column)).select(*rows.columns)


def decision_links(decisions: DataFrame) -> DataFrame:
    """The links that merge decisions state: all nodes that one decision names, in either array."""
    empty = F.array().cast("array<string>")
    named = F.concat(F.coalesce("node_ids", empty), F.coalesce("affected_nodes", empty))
    return links(decisions.where(F.col("action") == "merge"), named)


def decision_groups(decisions: DataFrame) -> DataFrame:
    """(group_key, node_key) of every node that merge decisions link to another one."""
    return components(decision_links(decisions)).select(F.col("label").alias("group_key"), F.col("node").alias("node_key"))
