"""Connected components by minimum labels with shortcuts, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import discard, materialize


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of every node that has a link; the root is the node of the component with the smallest rank.

    nodes: node (long, unique), rank (any ordered value, nulls last). links: a, b (long), in either direction. A round
    takes the smallest label among a node's neighbours and then the label of that label, so that chains halve; it ends
    when nothing changes. Sums are taken before the shuffle, and joins read written tables on both sides, so that
    Spark can split the partition of a node with very many links. Tables of finished rounds are deleted. Without links
    the result is empty.
    """
    # both directions come from one reading of a link, as a link may be found in another order when it is computed again
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = materialize(links.where("a != b").select(turned.alias("_l")).select("_l.a", "_l.b").distinct(), "links")
    own = F.struct(F.col("rank").isNull().alias("none"), F.col("rank"), F.col("node").alias("root"))
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = materialize(nodes.join(linked, "node", "left_semi").select("node", own.alias("label"), own.alias("old")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        hooked = materialize(hooked, "hooked")
        of = hooked.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = hooked.join(of, hooked["label.root"] == of["at"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        jumped = materialize(jumped, "labels")
        discard(labels, hooked)
        labels = jumped
        if not labels.where("label != old").limit(1).count():
            discard(both)
            return labels.select("node", F.col("label.root").alias("root"), F.col("label.rank").alias("rank"))
