"""Connected components of links, as tables: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget


def components(links: DataFrame) -> DataFrame:
    """(id, class) of every end of the links (a, b); the class is the least id.

    Each round a node takes the least class among its own and its neighbours', then the
    class of that class (paths halve); both steps are aggregates, so the many links of a
    hot node are added up before they are shuffled.  Every round's table is written to
    the shared folder, and the one before it deleted."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    now = last = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("class")), "classes")
    while True:
        near = edges.join(now.toDF("b", "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        step = now.join(near, "id").select("id", F.least("class", "near").alias("class"), F.col("class").alias("was"))
        jump = step.select(F.col("id").alias("class"), F.col("class").alias("further"))
        step = cut(step.join(jump, "class", "left").select("id", F.least("class", "further").alias("class"), "was"), "classes")
        forget(last)
        now, last = step.select("id", "class"), step
        if not step.where("class <> was").head(1):
            forget(edges)
            return now
