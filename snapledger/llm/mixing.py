"""Operator 10, mixing sources to target weights. Built from DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, shielded, text_key

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
SEED = "mix-1"
_BITS = 48


def _coin(text: Column, seed: str) -> Column:
    """48 uniform bits from the seed and a text, the same in every run."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, salts: int) -> DataFrame:
    """docs with words, coin, source as a text that is never null (null last), size class (digits of the size and the first two of them) and salt."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"__size": size, "__coin": _coin(F.col(id_col).cast("string"), seed), "__src": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))})
    digits = F.col("__size").cast("string")
    size_class, salt = F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"), F.expr(f"(__coin div {1 << 16}) * {salts} div {1 << 32}").cast("int")
    # neither is ever null; said so, no join condition asks, and the words aren't counted again for it
    return rows.withColumns({"__class": F.coalesce(size_class, F.lit(0)), "__salt": F.coalesce(salt, F.lit(0))})


def rates(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """(__src, __total, __target, __whole, __fraction, __u) of each source, from sizes (__src, __words).

    Targets fill up by weight under the cap in closed form: sources are taken in order of size/weight, and a source is at its cap when
    an equal share of what the capped ones before it leave would lift it to the cap or above. ``whole`` copies of every document are certain; ``fraction`` is
    the probability of one more; ``u`` is the source's seeded start. One row a source is ordered in one task (a million sources are 100 MB).
    """
    per = sizes.groupBy("__src").agg(F.sum("__words").alias("__total"))
    ranked = per.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(Window.orderBy("__src")) - 1) % len(WEIGHTS) + 1))
    fill = Window.orderBy(F.expr("__total / __w"), "__src")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    want = F.sum("__total").over(every) * (SHARE_PERCENT / 100)
    left = want - CAP * F.coalesce(F.sum("__total").over(before), F.lit(0))
    weight_left = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    capped = ranked.withColumn("__want", want).withColumn("__full", left / weight_left * F.col("__w") >= CAP * F.col("__total"))
    rest = F.col("__want") - F.coalesce(F.sum(F.when(F.col("__full"), CAP * F.col("__total"))).over(every), F.lit(0))
    rest_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(every)
    target = F.when(F.col("__full"), (CAP * F.col("__total")).cast("double")).otherwise(rest / rest_w * F.col("__w"))
    rate = F.when(F.col("__total") == 0, 0.0).otherwise(F.col("__target") / F.nullif("__total", F.lit(0)))
    return capped.withColumn("__target", target).select(
        "__src", "__total", "__target", F.floor(rate).cast("int").alias("__whole"), (rate - F.floor(rate)).alias("__fraction"), (_coin(F.col("__src"), seed) * F.lit(2.0**-_BITS)).alias("__u")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __copies (how often the mix takes the row).

    Every document is taken ``whole`` times, and once more with a probability that is exactly the fraction of its source's rate. The coins of a source's
    documents are tossed together: in the order of size class, salt, size and seeded hash, document i gets the further copy where floor(u + i * fraction)
    steps up, u being uniform by the seed. So documents of like sizes are taken evenly and the words come near the target, which independent coins would miss by
    much more. i is the start of the document's cell (source, class, salt), from the cells' counts, and its number in the cell; there are as many
    salts as keep cells small, so a source or a size with a third of all rows spreads over many tasks.

    Null text counts no words; null is a source of its own, ordered last; a source without words has target 0 and
    gives nothing. Rows that repeat an id share a hash and are ordered by text digest; equal rows are alike, so it doesn't matter which
    of them is taken. Texts of any length are counted whole. An empty table gives an empty table. Other columns pass through, but
    one that has the name of a column added here, or of one used on the way (``__src``, ``__coin``, ``__class``, ``__salt``), is replaced; ``emit`` keeps them all.
    """
    salts = max(1, int(math.sqrt(docs.count()) / 8))
    cell = ["__src", "__class", "__salt"]
    small = docs.select(F.col(id_col), F.col(text_col), F.col(source_col))
    cells = checkpointed(_sized(small, id_col, text_col, source_col, seed, salts).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")))
    start = F.sum("__n").over(Window.partitionBy("__src").orderBy("__class", "__salt")) - F.col("__n")
    plan = cells.select(*cell, start.alias("__start")).join(rates(cells.select("__src", "__words"), seed), "__src")
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("__size", "__coin", "__digest")) - 1
    rows = _sized(docs, id_col, text_col, source_col, seed, salts).withColumn("__digest", text_key(text_col)).withColumn("__own", own)
    i, f, u = F.col("__start") + F.col("__own"), F.col("__fraction"), F.col("__u")
    copies = F.col("__whole") + F.floor(u + (i + 1) * f) - F.floor(u + i * f)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.join(plan, cell).select(*kept, "__size", F.col("__total").alias("__source_size"), "__target", F.when(F.col("__total") == 0, 0).otherwise(copies).cast("int").alias("__copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    docs, back = shielded(docs, id_col, text_col, source_col)
    taken = mix(docs, id_col, text_col, source_col).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)


ORACLE = rf"""
WITH salts AS (SELECT greatest(1, floor(sqrt(count(*)) / 8))::BIGINT AS s FROM documents),
sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS coin
  FROM documents),
celled AS (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class, (coin // {1 << 16}) * (SELECT s FROM salts) // {1 << 32} AS salt FROM sized),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, coalesce('=' || source, '~') AS src FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY src) - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS w,
         CAST('0x' || substr(md5('{SEED}:' || src), 1, 12) AS BIGINT) * {2.0**-_BITS!r}::DOUBLE AS u FROM per),
capped AS (
  SELECT *, CAST(sum(total) OVER () AS DOUBLE) * {SHARE_PERCENT / 100} AS want,
         (CAST(sum(total) OVER () AS DOUBLE) * {SHARE_PERCENT / 100} - {CAP} * CAST(coalesce(sum(total) OVER b, 0) AS DOUBLE))
           / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) * w >= {CAP} * total AS full_up
  FROM ranked
  WINDOW b AS (ORDER BY CAST(total AS DOUBLE) / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, total, target, u, CASE WHEN total = 0 THEN 0::DOUBLE ELSE target / total END AS rate FROM (
    SELECT *, CASE WHEN full_up THEN CAST({CAP} * total AS DOUBLE) ELSE
      (want - CAST(coalesce(sum(CASE WHEN full_up THEN {CAP} * total END) OVER (), 0) AS DOUBLE))
        / CAST(sum(CASE WHEN NOT full_up THEN w END) OVER () AS DOUBLE) * w END AS target FROM capped)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, coin) - 1 AS i FROM celled)
SELECT s.doc_id, s.size, t.total AS source_size, t.target,
       CAST(s.size * CASE WHEN t.total = 0 THEN 0 ELSE floor(rate) + floor(u + (i + 1) * (rate - floor(rate))) - floor(u + i * (rate - floor(rate))) END AS BIGINT) AS taken
FROM placed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""
