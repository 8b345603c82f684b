"""Writing that is refused as a whole: rows go to a folder of their own with their violations counted in the same job, and are published only if there are none."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import published, publish, remove


class Refused(Exception):
    """A write that broke a rule; ``violations`` has (table, rule) and how many rows."""

    def __init__(self, violations: dict[tuple[str, str], int]):
        super().__init__(", ".join(f"{t}: {r} ({n})" for (t, r), n in sorted(violations.items())))
        self.violations = violations


@dataclass
class Table:
    """Rows to be written, the rules that none may break (name and condition of a violation; NULL is none), and how many rows there must be, if that is known."""

    rows: DataFrame
    rules: dict[str, Column]
    expected: int | None = None


def linked(rows: DataFrame, column: str, parents: DataFrame, parent_key: str, flag: str) -> DataFrame:
    """rows with a flag that says that the column names no parent; NULL names none and breaks nothing. parent_key is unique among parents."""
    known = parents.select(F.col(parent_key).alias("__p"), F.lit(True).alias("__known"))
    return rows.join(known, F.col(column) == F.col("__p"), "left").withColumn(flag, F.col(column).isNotNull() & F.col("__known").isNull()).drop("__p", "__known")


def links(rows: DataFrame, key: list[str], array: str, name: str) -> DataFrame:
    """An array of links as rows of their own, once each, so that each can be checked as a link; a NULL or empty array has none."""
    return rows.select(*key, F.explode(array).alias(name)).distinct()


def write_all(spark: SparkSession, root: str, tables: dict[str, Table]) -> dict[tuple[str, str], int]:
    """Write the tables under root, or none of them: (table, rule) and the violations counted.

    Each table is written to a new folder, and the same job counts its rows and what breaks each rule, so nothing is read twice. If any count isn't zero, or a table's rows aren't
    as many as expected, the folders are removed and ``Refused`` is raised: readers of root never see a part. Else one small file names the new folder, created only if no
    other writer has created it first; the state before stays until then and after.
    """
    folder = f"{root}/{uuid.uuid4().hex}"
    seen: dict[tuple[str, str], int] = {}
    try:
        for name, table in tables.items():
            counts = Observation(f"{name}-{uuid.uuid4().hex}")
            flags = {rule: f"__v{k}" for k, rule in enumerate(table.rules)}
            rows = table.rows.observe(counts, F.count(F.lit(1)).alias("__rows"), *[F.coalesce(F.count_if(table.rules[r]), F.lit(0)).alias(f) for r, f in flags.items()])
            rows.select(*[c for c in table.rows.columns if not c.startswith("__")]).write.mode("errorifexists").parquet(f"{folder}/{name}")
            got = counts.get
            seen |= {(name, rule): got[f] for rule, f in flags.items()}
            if table.expected is not None:
                seen[name, "contagem"] = abs(got["__rows"] - table.expected)
        if any(seen.values()):
            raise Refused({k: n for k, n in seen.items() if n})
        publish(spark, root, folder.rpartition("/")[2])
    except BaseException:
        remove(spark, folder)
        raise
    return seen


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table as last published under root; None before the first time."""
    folder = published(spark, root)
    return None if folder is None else spark.read.parquet(f"{root}/{folder}/{name}")
