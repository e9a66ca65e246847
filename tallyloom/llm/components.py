"""Connected components of a link table, by contraction in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Workspace


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(v, component): every vertex of `links` (a, b: long, not NULL) and the smallest one it reaches.

    Each round hooks every vertex to its smallest smaller neighbour, follows the hooks two steps, and
    replaces links by links between hooked-to vertices, until no link joins two different ones. A vertex
    with very many links costs no more than its rows: minima are taken map-side first, and the joins are
    rows to a unique lookup, which adaptive execution may split.
    """
    work = Workspace(links.sparkSession, name)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = work.keep(links.select(*pair("a", "b")).where("a < b").distinct(), "edges-0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v"))
    labels = work.keep(labels, "labels-0")
    k = 0
    while not edges.isEmpty():
        k += 1
        hooks = work.keep(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), f"hooks-{k}")
        for turn in range(2):
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hooks = work.keep(hooks.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), f"hooks-{k}-{turn}")
        on = lambda rows, column: rows.join(hooks.withColumnsRenamed({"v": column, "p": f"to_{column}"}), column, "left").withColumn(column, F.coalesce(f"to_{column}", column)).drop(f"to_{column}")
        labels = work.keep(on(labels, "component"), f"labels-{k}")
        edges = work.keep(on(on(edges, "a"), "b").select(*pair("a", "b")).where("a < b").distinct(), f"edges-{k}")
        work.drop(f"labels-{k - 1}", f"edges-{k - 1}", f"hooks-{k}", f"hooks-{k}-0", f"hooks-{k}-1")
    return labels
