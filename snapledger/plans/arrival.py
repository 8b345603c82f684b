"""JSON arrival on the test tables: pages are written from orders, then read back under the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import format_cents, text_cents
from ..sources import contracts, statements
from ..sources.ledger import CUTS, read, tasks
from .indicators import STATEMENT_SQL, statement
from .registry import query

#: Rows of a page.
PAGE = 100


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages (pagina, body): PAGE orders each; some money fields are absent, null, text, or have three decimals."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    zero = {f: F.lit("0") for f in contracts.MONEY_FIELDS}
    proc = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, "null").when(k % 11 == 2, F.concat(F.lit('"'), price.cast("string"), F.lit('"'))).when(k % 11 == 3, F.concat(price.cast("string"), F.lit("4"))).when(k % 11 == 4, "true").otherwise(price.cast("string"))
    field = lambda n, v: F.concat(F.lit(f'"{n}":'), v)
    texts = [field(n, F.lit('"x"')) for n in contracts.TEXT_FIELDS[:-1]] + [field("dataEmissao", F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"')))]
    numbers = [field("entidade", (F.col("o_custkey") % 5).cast("string")), field("anoempenho", F.year("o_orderdate").cast("string")), field("empenho", k.cast("string")), field("fonteRecurso", F.lit("1")), field("fornecedor", F.lit("2"))]
    money = [field("proc", proc), *[field(n, v) for n, v in zero.items() if n != "proc"]]
    record = F.concat(F.lit("{"), F.concat_ws(",", *numbers, *texts, *money), F.lit("}"))
    rows = read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {PAGE}").alias("pagina"), k.alias("k"), record.alias("r")).repartition(tasks(spark, sf_dir), "pagina")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]), ",")  # at most PAGE rows
    return rows.groupBy("pagina").agg(F.concat(F.lit('{"content":['), content, F.lit("]}")).alias("body"))


@query(f"""SELECT o_orderkey // {PAGE} AS pagina, o_orderkey AS empenho, (o_custkey % 5)::BIGINT AS entidade, year(o_orderdate)::BIGINT AS anoempenho, strftime(o_orderdate, '%Y-%m-%d') AS emissao, round(o_totalprice * 100)::BIGINT AS proc_c, 7::BIGINT AS ausentes FROM orders WHERE o_orderkey % 11 > 4""")
def ingest_records(spark, sf_dir):
    found = contracts.records(contracts.items(pages(spark, sf_dir), ["pagina"]), ["pagina"])
    return found.select("pagina", "empenho", "entidade", "anoempenho", F.date_format("data_emissao", "yyyy-MM-dd").alias("emissao"), "proc_c", F.size("chaves_ausentes").cast("long").alias("ausentes"))


@query(f"""WITH p AS (SELECT o_orderkey // {PAGE} AS pagina, CASE o_orderkey % 11 WHEN 0 THEN 'ausente' WHEN 1 THEN 'nulo' WHEN 2 THEN 'invalido' WHEN 3 THEN 'invalido' WHEN 4 THEN 'invalido' END AS motivo FROM orders)
SELECT pagina, 'proc' AS campo, motivo, count(*)::BIGINT AS valores FROM p WHERE motivo IS NOT NULL GROUP BY ALL""")
def ingest_refusals(spark, sf_dir):
    bad = contracts.refused_values(contracts.items(pages(spark, sf_dir), ["pagina"]), ["pagina"])
    return bad.groupBy("pagina", "campo", "motivo").agg(F.count(F.lit(1)).alias("valores"))


@query(f"""SELECT o_orderkey // {PAGE} AS pagina, CASE o_orderkey % 11 WHEN 0 THEN 'chave ausente: proc' ELSE 'tipo: proc' END AS violacao, count(*)::BIGINT AS registros FROM orders WHERE o_orderkey % 11 IN (0, 1, 2, 4) GROUP BY ALL""")
def ingest_contract(spark, sf_dir):
    """Records that break the contract, by page and rule."""
    found = contracts.record_violations(contracts.items(pages(spark, sf_dir), ["pagina"]), ["pagina"])
    return found.groupBy("pagina", "violacao").agg(F.count(F.lit(1)).alias("registros"))


@query(f"{STATEMENT_SQL} SELECT entidade, ex, df, coluna, valor, 'completa' AS situacao FROM stm WHERE versao = 'v2' AND coluna NOT IN ('S1', 'S2', 'S3')")
def declaration_parsed(spark, sf_dir):
    """The statement written as a declaration without its zero cells, and read back."""
    cells = statement(spark, sf_dir, ("v2",)).where(~F.col("coluna").isin("S1", "S2", "S3") & (F.col("valor") != 0))
    balance = {"e": "Saldo e", "k": "Saldo k", "L": "Saldo Total L"}
    label = F.coalesce(*[F.when(F.col("coluna") == k, v) for k, v in balance.items()], F.concat(F.lit("Restos a pagar ("), F.col("coluna"), F.lit(")")))
    items = cells.select("entidade", "ex", "df", label.alias("coluna"), F.lit("TOTAL (III) = (I + II)").alias("conta"), (F.col("valor").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string").alias("valor"))
    return statements.declaration(items, ["entidade", "ex", "df"]).select("entidade", "ex", "df", "coluna", "valor", "situacao")


@query("WITH c AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS v FROM customer) SELECT c_custkey, v AS centavos, CASE WHEN v < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(v) // 100), ',', '.') || ',' || lpad((abs(v) % 100)::VARCHAR, 2, '0') AS texto FROM c")
def money_text(spark, sf_dir):
    """Cents written for reading and read back exactly."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    text = format_cents(cents)
    return read(spark, sf_dir, "customer").select("c_custkey", text_cents(text).alias("centavos"), text.alias("texto"))


@query(f"SELECT entidade, count(*)::BIGINT AS cortes FROM (SELECT r_regionkey::BIGINT AS entidade, y, md FROM region, (SELECT unnest(range(1996, 2002)) AS y), (VALUES {', '.join(f"('{c}')" for c in CUTS)}) c(md)) GROUP BY entidade")
def cutoff_universe(spark, sf_dir):
    """Every entity with every cut-off of the years, whether collected or not."""
    years = F.explode(F.sequence(F.lit(1996), F.lit(2001))).alias("y")
    grid = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("entidade"), years).select("entidade", "y", F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("md"))
    return grid.groupBy("entidade").agg(F.count(F.lit(1)).alias("cortes"))
