"""Field trees: roots, inherited types and the nodes that survive, by rounds of joins over written tables.

A round doubles the distance that is known, so a tree of depth n takes log2(n) rounds, whatever the number of forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.plans.store import written

#: Levels above a node that a tree may have, and levels that a property is looked for.
MAX_DEPTH, INHERITED = 65, 8


def _parents(nodes: DataFrame) -> DataFrame:
    """nodes (form_id, node, parent, more) with `up`: the parent if it is a node of the form, else null."""
    known = nodes.select("form_id", F.col("node").alias("parent"), F.col("node").alias("up"))
    return nodes.join(known, ["form_id", "parent"], "left").select(*nodes.columns, "up")


def field_roots(spark: SparkSession, field_nodes: DataFrame) -> DataFrame:
    """Root and depth of every node; null for nodes on or below a cycle, and for those with more than MAX_DEPTH levels above."""
    state = _parents(field_nodes.select("form_id", "node", "parent"))
    state = written(state.select("form_id", "node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("depth")), "roots")
    for _ in range(MAX_DEPTH.bit_length()):
        above = state.select("form_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        deeper = F.least(F.col("depth") + F.col("more"), F.lit(2 * MAX_DEPTH))
        found = written(state.join(above, ["form_id", "up"]).select("form_id", "node", F.col("next").alias("up"), deeper.alias("depth"), ((F.col("more") > 0) & (deeper <= MAX_DEPTH)).alias("open")), "roots")
        state = found.drop("open")
        if not found.where("open").limit(1).count():
            break
    near = F.col("depth") <= MAX_DEPTH
    return state.select("form_id", "node", F.when(near, F.col("up")).alias("root"), F.when(near, F.col("depth")).alias("depth"))


def field_inherit(spark: SparkSession, field_nodes: DataFrame) -> DataFrame:
    """The nearest field type of a node itself or of its ancestors, up to INHERITED levels."""
    own = field_nodes.select("form_id", "node", "parent", "ft")
    state = _parents(own).select("form_id", "node", "up", "ft")
    reach = 1  # nodes looked at so far: the node itself
    while reach < INHERITED:
        above = state.select("form_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("ft").alias("more"))
        state = written(state.join(above, ["form_id", "up"], "left").select("form_id", "node", F.col("next").alias("up"), F.coalesce("ft", "more").alias("ft")), "inherit")
        reach *= 2
    last = own.select("form_id", F.col("node").alias("up"), F.col("ft").alias("more"))
    return state.join(last, ["form_id", "up"], "left").select("form_id", "node", F.coalesce("ft", "more").alias("ft"))


def prune_fields(spark: SparkSession, field_nodes: DataFrame, kept_widgets: DataFrame) -> DataFrame:
    """The widgets that are kept (form_id, node) and all their ancestors (of up to 2 * MAX_DEPTH levels)."""
    jump = written(_parents(field_nodes.select("form_id", "node", "parent")).where("up is not null").select("form_id", "node", "up"), "jump")
    alive = written(kept_widgets.select("form_id", "node").distinct(), "alive")
    for _ in range(MAX_DEPTH.bit_length()):  # jump: the node 1, 2, 4 ... levels up
        above = alive.join(jump, ["form_id", "node"]).select("form_id", F.col("up").alias("node"))
        alive = written(alive.unionByName(above).distinct(), "alive")
        further = jump.select("form_id", F.col("node").alias("up"), F.col("up").alias("next"))
        jump = written(jump.join(further, ["form_id", "up"]).select("form_id", "node", F.col("next").alias("up")), "jump")
        if not jump.limit(1).count():
            break
    return alive
