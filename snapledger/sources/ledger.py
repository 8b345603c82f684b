"""The ledger on the test tables: orders as commitments, lines as their balances, regions as reporting entities.

A line belongs to fiscal year ``ex`` if its order is of an earlier year and it ships in or after ex. Its cents count as processed
(line status F) or not processed (O); what has shipped by a cut-off is paid, liquidated, or (flag R) cancelled. Payments of untaxed lines
with flag A count as reversed, for information: nothing is taken from the balances for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents
from .store import size_of

#: Cut-offs of a year, month and day.
CUTS = ("04-30", "08-31", "12-31")
MONEY = ["proc", "aproc", "pago_proc", "pago_proc_estornado", "pago_aproc", "pago_aproc_estornado", "cancelado_proc", "cancelado_aproc", "liquidado", "retencao"]
CUTOFF = ["ex", "df"]
#: Settled by a cut-off: payments (processed, not processed), cancellations, reversals (processed, not processed).
FLOWS = ("pp", "pa", "ca", "ep", "ea")
#: Tables that the ledger is made of, and the version of the rules that make it.
SOURCES, VERSION = ("lineitem", "orders", "customer", "nation"), "2"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with entity and dimensions; customer and nation are the small sides."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_regionkey").cast("long").alias("entidade"), F.year("o_orderdate").cast("long").alias("anoempenho"), F.col("o_orderkey").alias("empenho"),
            F.col("c_nationkey").cast("long").alias("nacao"), F.col("c_mktsegment").alias("segmento"), F.col("o_orderpriority").alias("prioridade"), F.col("o_orderstatus").alias("situacao"),
        )
    )


#: Bytes of the lines' files that one task takes; what a task holds in memory follows from it, not from the number of shuffle partitions.
PORTION = 4 << 20
KEYS = ["entidade", "anoempenho", "empenho", "nacao", "segmento", "prioridade", "situacao", "ex"]


def portions(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the ledger's rows take, by the size of the lines' files."""
    return max(1, -(-size_of(spark, [f"{sf_dir}/lineitem.parquet"]) // PORTION))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a shuffle of the ledger's rows: as many as the session has, more where a partition would grow with the tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), portions(spark, sf_dir))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (entity, fiscal year, cut-off, commitment), money in cents."""
    return at_cuts(balances(spark, sf_dir))


def dealt(wide: DataFrame, parts: int) -> DataFrame:
    """Balances dealt to some ``parts`` tasks, each of which has a share of one year by the commitments' hash; they are moved before the cut-offs triple them."""
    shares, years = -(-parts // 8), 16
    return wide.repartitionById(shares * years, (F.pmod("ex", F.lit(years)) * shares + F.pmod(F.hash("empenho"), F.lit(shares))).cast("int"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (entity, fiscal year, commitment), with what is settled by each cut-off side by side.

    Lines are shuffled once, by order, and everything else keeps that partitioning: lines are summed by order and shipping year (only
    what ships within a year can be settled in it), orders join their sums, and the sums of the years from ex on make the balances of ex.
    """
    ship = F.col("ship")
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", cents(F.col("l_extendedprice")).alias("v"), F.round(F.col("l_discount") * 100).cast("long").alias("pct"), (F.col("l_linestatus") == "F").alias("f"), (F.col("l_returnflag") == "R").alias("r"), ((F.col("l_returnflag") == "A") & (F.col("l_tax") == 0)).alias("x"), F.col("l_shipdate").cast("date").alias("ship")
    )
    line = line.withColumns({"sy": F.year("ship").cast("long"), "md": F.month(ship) * 100 + F.dayofmonth(ship)})
    v, f, r, x = F.col("v"), F.col("f"), F.col("r"), F.col("x")
    flows = []
    for i, cut in enumerate(CUTS):
        done = F.col("md") <= int(cut.replace("-", ""))
        flows += [F.sum(F.when(done & f & ~r, v).otherwise(0)).alias(f"pp{i}"), F.sum(F.when(done & ~f & ~r, v).otherwise(0)).alias(f"pa{i}"), F.sum(F.when(done & r, v).otherwise(0)).alias(f"ca{i}"), F.sum(F.when(done & f & x, v).otherwise(0)).alias(f"ep{i}"), F.sum(F.when(done & ~f & x, v).otherwise(0)).alias(f"ea{i}")]
    by_year = line.repartition(tasks(spark, sf_dir), "l_orderkey").groupBy("l_orderkey", "sy").agg(F.sum(F.when(f, v).otherwise(0)).alias("p"), F.sum(F.when(f, 0).otherwise(v)).alias("a"), F.sum(v * F.col("pct")).alias("ret"), *flows)
    rows = by_year.join(order_facts(spark, sf_dir), F.col("l_orderkey") == F.col("empenho")).where("sy > anoempenho")
    rows = rows.withColumn("ex", F.explode(F.sequence(F.col("anoempenho") + 1, F.col("sy"))))
    own = F.col("sy") == F.col("ex")
    settled = [F.sum(F.when(own, F.col(f"{n}{i}")).otherwise(0)).alias(f"{n}{i}") for i in range(len(CUTS)) for n in FLOWS]
    return rows.groupBy("l_orderkey", *KEYS).agg(F.sum("p").alias("proc"), F.sum("a").alias("aproc"), F.expr("sum(ret) div 100").alias("retencao"), *settled).drop("l_orderkey")


def at_cuts(wide: DataFrame) -> DataFrame:
    """Balances spread out over the cut-offs of their year."""
    at = F.explode(F.array(*[F.struct(F.concat(F.col("ex").cast("string"), F.lit(f"-{cut}")).alias("df"), *[F.col(f"{n}{i}").alias(n) for n in FLOWS]) for i, cut in enumerate(CUTS)]))
    return wide.withColumn("c", at).select(
        *KEYS, F.col("c.df").alias("df"), "proc", "aproc", F.col("c.pp").alias("pago_proc"), F.col("c.ep").alias("pago_proc_estornado"), F.col("c.pa").alias("pago_aproc"), F.col("c.ea").alias("pago_aproc_estornado"), F.lit(0).cast("long").alias("cancelado_proc"), F.col("c.ca").alias("cancelado_aproc"), F.col("c.pa").alias("liquidado"), "retencao"
    )


#: The same rows in SQL: relation ``base``.
BASE_SQL = f"""
cuts(md) AS (VALUES {", ".join(f"('{c}')" for c in CUTS)}),
line AS (
  SELECT n_regionkey::BIGINT AS entidade, year(o_orderdate)::BIGINT AS anoempenho, o_orderkey AS empenho, c_nationkey::BIGINT AS nacao,
         c_mktsegment AS segmento, o_orderpriority AS prioridade, o_orderstatus AS situacao,
         round(l_extendedprice * 100)::BIGINT AS v, round(l_discount * 100)::BIGINT AS pct, l_linestatus AS ls, l_returnflag AS rf, l_tax = 0 AS untaxed, l_shipdate::DATE AS ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lex AS (SELECT line.*, y.ex::BIGINT AS ex FROM line, (SELECT unnest(range(1990, 2010)) AS ex) y WHERE y.ex > anoempenho AND y.ex <= year(ship)),
base AS (
  SELECT entidade, anoempenho, empenho, nacao, segmento, prioridade, situacao, ex, ex::VARCHAR || '-' || md AS df,
    sum(CASE WHEN ls = 'F' THEN v ELSE 0 END)::BIGINT AS proc, sum(CASE WHEN ls = 'O' THEN v ELSE 0 END)::BIGINT AS aproc,
    sum(CASE WHEN ls = 'F' AND rf <> 'R' AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS pago_proc,
    sum(CASE WHEN ls = 'O' AND rf <> 'R' AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS pago_aproc,
    sum(CASE WHEN ls = 'F' AND rf = 'A' AND untaxed AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS pago_proc_estornado,
    sum(CASE WHEN ls = 'O' AND rf = 'A' AND untaxed AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS pago_aproc_estornado,
    0::BIGINT AS cancelado_proc,
    sum(CASE WHEN rf = 'R' AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS cancelado_aproc,
    sum(CASE WHEN ls = 'O' AND rf <> 'R' AND ship <= (ex::VARCHAR || '-' || md)::DATE THEN v ELSE 0 END)::BIGINT AS liquidado,
    (sum(v * pct) // 100)::BIGINT AS retencao
  FROM lex, cuts GROUP BY ALL)"""
