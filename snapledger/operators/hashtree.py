"""A tree of hashes over ordered objects: growth is allowed, loss and change are not, and are found from the root down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_hash, set_hash
from ..sources.store import cut

#: Objects of a leaf (by order), and children of a node.
WIDTH, FAN = 1024, 16


def leaves(objects: DataFrame, order: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """objects with folha, the range of the order (a whole number that only grows) that holds them, and the row's hash."""
    return objects.withColumns({"folha": F.floor(F.col(order) / width).cast("long"), "hash": row_hash(order, *columns)})


def tree(objects: DataFrame, order: str, columns: list[str], width: int = WIDTH, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(nivel, no, linhas, hash) of all nodes: level 0 has the leaves; a node's hash is that of its children's hashes, and the top level has one node.

    Objects are read once and hashed by leaf with a map-side part; each level above is an aggregate of the one below, a ``fan``-th of its size, cut from its lineage. ``levels`` fixes the height, so that trees of
    different sizes can be compared; without it the greatest order gives it (one row to the driver).
    """
    if levels is None:
        most = objects.agg(F.max(order)).first()[0] or 0
        levels = 1
        while most // width >= fan**levels:
            levels += 1
    level = leaves(objects, order, columns, width).groupBy(F.col("folha").alias("no")).agg(F.count(F.lit(1)).alias("linhas"), set_hash("hash").alias("hash"))
    every = [cut(level.select(F.lit(0).alias("nivel"), "no", "linhas", "hash"))]
    for k in range(1, levels + 1):
        child = every[-1].withColumn("h", row_hash("no", "linhas", "hash"))
        above = child.groupBy(F.floor(F.col("no") / fan).cast("long").alias("no")).agg(F.sum("linhas").alias("linhas"), set_hash("h").alias("hash"))
        every.append(cut(above.select(F.lit(k).alias("nivel"), "no", "linhas", "hash")))
    return reduce(DataFrame.unionByName, every)


def differing(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """Nodes of a stored old tree that the new one hasn't alike, from the root down: below a node that is alike nothing is looked at. Nodes that only the new tree has are growth."""
    top = old.agg(F.max("nivel")).first()[0]
    found, above = [], None
    for k in range(top if top is not None else -1, -1, -1):
        a, b = old.where(F.col("nivel") == k), new.where(F.col("nivel") == k).select("no", F.col("hash").alias("agora"))
        if above is not None:
            a = a.withColumn("__acima", F.floor(F.col("no") / fan).cast("long")).join(above, "__acima", "left_semi").drop("__acima")
        unlike = cut(a.join(b, "no", "left").where("agora is null or agora <> hash").select("nivel", "no", "linhas"))
        found.append(unlike)
        above = unlike.select(F.col("no").alias("__acima"))
    return reduce(DataFrame.unionByName, found) if found else old.select("nivel", "no", "linhas").limit(0)


def losses(old: DataFrame, new: DataFrame, unlike: DataFrame, order: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """(order, situacao) of the objects of differing leaves that are lost or changed. Only rows of those leaves are compared; added objects are no fault."""
    at = unlike.where("nivel = 0").select(F.col("no").alias("folha"))
    mine = lambda df: leaves(df, order, columns, width).join(at, "folha", "left_semi").select(order, "hash")
    now = mine(new).groupBy(order).agg(F.collect_set("hash").alias("agora"))
    kind = F.when(F.col("agora").isNull(), "perdido").when(~F.array_contains("agora", F.col("hash")), "alterado")
    return mine(old).join(now, order, "left").select(order, kind.alias("situacao")).where("situacao is not null")
