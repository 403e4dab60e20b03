"""Connected components as a DataFrame loop; each round is written, so that no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import written


def components(edges: DataFrame) -> DataFrame:
    """id, label for every end of ``edges`` (a, b): label is the smallest id of its component.

    In each round an id goes to the smallest among itself and its neighbours, and along these to one that is smaller than all of its own.
    Then edges are drawn between those alone, each once, so that edges inside what has grown together are not looked at again; at least
    half of the ids of a component go in a round. Messages are combined before the shuffle: a hub's are one for each task.
    """
    pairs = written(_once(edges, "a", "b"), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        rounds.append(_ends_of_chains(written(ends.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")))
        one, other = (rounds[-1].select(F.col("id").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
        pairs = written(_once(pairs.join(one, "a").join(other, "b").filter("_a <> _b"), "_a", "_b"), "edges")
    found = rounds.pop()
    for finer in reversed(rounds):
        coarse = found.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        found = finer.join(coarse, finer["label"] == coarse["_id"], "left").select("id", F.coalesce("_label", "label").alias("label"))
    return written(found, "labels") if rounds else found


def _once(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _ends_of_chains(labels: DataFrame) -> DataFrame:
    """id, label with the label of the label, and so on, to one that is its own; chains shrink by halves."""
    while True:
        own = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        jumped = labels.join(own, labels["label"] == own["_id"]).select("id", F.col("label").alias("old"), F.col("_label").alias("label"))
        after = written(jumped, "labels")
        labels = after.select("id", "label")
        if after.filter("label <> old").isEmpty():
            return labels
