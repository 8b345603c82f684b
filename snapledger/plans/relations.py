"""Pairs, reconciliation, quality, governance, lists, sets, contracts and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..functions.text import creditor_type, mask_tokens
from ..operators import integrity as integ
from ..operators import pairing as pair
from ..operators import reconcile as rec_ops
from ..operators import series as ser
from ..operators import validity as val
from ..operators.indicators import SUMS, indicators
from ..operators.rules import COLUMNS, MOVEMENTS, anomalies, movement_effect, statement_columns
from ..sources import contracts
from ..sources.contracts import path_types
from ..sources.ledger import read, tasks
from .arrival import pages
from .history import SNAP_SQL, snapshots
from .indicators import ALL_SUMS, ANOMALIES_SQL, COPIES, ORIGINALS, STATEMENT_SQL, _columns_sql, copy_base, records, statement
from .registry import RECORDS, query

MATCH = ["situacao"]
PAIRS_SQL = f"""{RECORDS}, half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), px AS (
 SELECT a.ex, a.df, a.anoempenho, a.empenho AS a_empenho, b.empenho AS b_empenho, a.proc AS a_proc, a.aproc AS a_aproc, b.proc AS b_proc, b.aproc AS b_aproc,
  CASE WHEN a.proc = b.proc AND a.aproc = b.aproc THEN 'igual' WHEN a.proc + a.aproc = b.s1 THEN 'a_e_saldo_final_de_b' ELSE 'outra' END AS relacao,
  abs(a.pago_proc) + abs(a.pago_aproc) + abs(a.cancelado_aproc) + abs(a.liquidado) > 0 AS xa, abs(b.pago_proc) + abs(b.pago_aproc) + abs(b.cancelado_aproc) + abs(b.liquidado) > 0 AS xb
 FROM rec a, half, rec b WHERE a.entidade = {COPIES} AND a.empenho >= base_no AND b.entidade = {ORIGINALS} AND b.empenho = a.empenho - base_no AND a.ex = b.ex AND a.df = b.df AND a.anoempenho = b.anoempenho AND a.situacao IS NOT DISTINCT FROM b.situacao),
pr AS (SELECT * EXCLUDE (xa, xb), CASE WHEN xa AND xb THEN 'ambos' WHEN xa THEN 'A' WHEN xb THEN 'B' ELSE 'nenhum' END AS lado FROM px)"""
MISSING_SQL = f"SELECT a.* FROM rec a, half WHERE a.entidade = {COPIES} AND a.empenho >= base_no AND NOT EXISTS (SELECT 1 FROM rec b, half h2 WHERE b.entidade = {ORIGINALS} AND b.empenho = a.empenho - h2.base_no AND a.ex = b.ex AND a.df = b.df AND a.anoempenho = b.anoempenho AND a.situacao IS NOT DISTINCT FROM b.situacao)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair.pairs(records(spark, sf_dir), COPIES, ORIGINALS, copy_base(spark, sf_dir), MATCH)


@query(f"{PAIRS_SQL} SELECT * FROM pr")
def pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"{PAIRS_SQL} SELECT ex, df, relacao, lado, count(*)::BIGINT AS pares, sum(a_proc + a_aproc)::BIGINT AS inscricao_a, sum(b_proc + b_aproc)::BIGINT AS inscricao_b FROM pr GROUP BY ALL")
def pairs_summary(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("ex", "df", "relacao", "lado").agg(F.count(F.lit(1)).alias("pares"), F.sum(F.col("a_proc") + F.col("a_aproc")).cast("long").alias("inscricao_a"), F.sum(F.col("b_proc") + F.col("b_aproc")).cast("long").alias("inscricao_b"))


@query(f"{PAIRS_SQL}, ms AS ({MISSING_SQL}) SELECT ex, df, anoempenho, empenho, proc, aproc FROM ms")
def pair_missing(spark, sf_dir):
    return pair.unpaired(records(spark, sf_dir), COPIES, ORIGINALS, copy_base(spark, sf_dir), MATCH).select("ex", "df", "anoempenho", "empenho", "proc", "aproc")


IDLE_SQL = "r.pago_proc = 0 AND r.pago_aproc = 0 AND r.cancelado_aproc = 0 AND r.liquidado = 0"


def _consolidated_sql(first: int | None) -> str:
    inside = "" if first is None else f" AND a.ex >= {first}"
    return f"""{RECORDS}, half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), al AS (SELECT r.* FROM rec r WHERE NOT (r.entidade = {ORIGINALS} AND {IDLE_SQL} AND EXISTS (SELECT 1 FROM rec a, half WHERE a.entidade = {COPIES} AND a.empenho >= base_no
 AND a.empenho = r.empenho + base_no AND a.anoempenho = r.anoempenho AND a.ex = r.ex AND a.df = r.df AND a.proc = r.proc AND a.aproc = r.aproc AND a.situacao IS NOT DISTINCT FROM r.situacao{inside})))"""


@query(f"{_consolidated_sql(None)} SELECT ex, df, {ALL_SUMS} FROM al GROUP BY ALL")
def consolidated_anti(spark, sf_dir):
    """Indicators without the originals whose copies replace them."""
    return indicators(pair.consolidated(records(spark, sf_dir), COPIES, ORIGINALS, copy_base(spark, sf_dir), MATCH), ["ex", "df"])


#: The first fiscal year of copies that count.
FIRST = 1999


@query(f"{_consolidated_sql(FIRST)} SELECT ex, df, {ALL_SUMS} FROM al, half WHERE NOT (entidade = {COPIES} AND empenho >= base_no AND ex < {FIRST}) GROUP BY ALL")
def consolidated_v4(spark, sf_dir):
    """Both scope rules together: copies before their first year are out and replace nothing."""
    rec, base = records(spark, sf_dir), copy_base(spark, sf_dir)
    kept = pair.consolidated(rec, COPIES, ORIGINALS, base, MATCH, FIRST)
    return indicators(kept.where(~(pair.is_copy(COPIES, base) & (F.col("ex") < FIRST))), ["ex", "df"])


@query(f"{RECORDS}, half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders) SELECT ex, df, {ALL_SUMS} FROM rec, half WHERE NOT (entidade = {COPIES} AND empenho >= base_no AND ex < 1999) GROUP BY ALL")
def scope_excluded(spark, sf_dir):
    outside = pair.is_copy(COPIES, copy_base(spark, sf_dir)) & (F.col("ex") < 1999)
    return indicators(records(spark, sf_dir).where(~outside), ["ex", "df"])


def _adjust_sql() -> str:
    v = lambda n: f"CASE WHEN fora = 'a' THEN a_{n} ELSE b_{n} END"
    last = "anoempenho = ex - 1"
    parts = [(f"CASE WHEN {last} THEN 'b' ELSE 'a' END", "greatest(p, 0)"), (f"CASE WHEN {last} THEN 'g' ELSE 'f' END", "greatest(n, 0)"), ("'e'", "greatest(p, 0)"), ("'k'", "greatest(n, 0)"), ("'L'", "greatest(p, 0) + greatest(n, 0)"), ("'S1'", "p + n"), ("'S2'", "n"), ("'S3'", "p")]
    rows = " UNION ALL ".join(f"SELECT ex, df, {c} AS coluna, -({a}) AS ajuste FROM fo" for c, a in parts)
    return f"fo AS (SELECT *, {v('proc')} AS p, {v('aproc')} AS n FROM (SELECT *, CASE WHEN lado <> 'ambos' AND relacao IN ('igual', 'a_e_saldo_final_de_b') THEN 'a' END AS fora FROM pr) WHERE fora IS NOT NULL), aj AS (SELECT ex, df, coluna, sum(ajuste) AS ajuste FROM ({rows}) GROUP BY ALL)"


@query(f"{STATEMENT_SQL}, mu AS (SELECT ex, df, coluna, sum(valor)::BIGINT AS publicado FROM stm WHERE versao = 'v2' GROUP BY ALL), {PAIRS_SQL.removeprefix(RECORDS + ', ')}, {_adjust_sql()} SELECT mu.ex, mu.df, mu.coluna, publicado, coalesce(ajuste, 0)::BIGINT AS ajuste, (publicado + coalesce(ajuste, 0))::BIGINT AS analitico FROM mu LEFT JOIN aj ON mu.ex = aj.ex AND mu.df = aj.df AND mu.coluna = aj.coluna")
def analytical_view_adjusted(spark, sf_dir):
    city = statement(spark, sf_dir, ("v2",)).groupBy("ex", "df", "coluna").agg(F.sum("valor").cast("long").alias("publicado"))
    less = pair.adjustments(_pairs(spark, sf_dir), "v2")
    return city.join(less, ["ex", "df", "coluna"], "left").withColumn("ajuste", F.coalesce("ajuste", F.lit(0)).cast("long")).withColumn("analitico", F.col("publicado") + F.col("ajuste"))


EFFECT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, (e, _) in MOVEMENTS.items()) + " ELSE 'desconhecido' END"
SIGN_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, s) in MOVEMENTS.items()) + " ELSE 0 END"


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect, sign = movement_effect(F.col("event_type"))
    return snapshots(spark, sf_dir).withColumn("efeito", effect).withColumn("sinal", sign)


@query(f"{SNAP_SQL} SELECT event_type, {EFFECT_SQL} AS efeito, ({SIGN_SQL})::BIGINT AS sinal, count(*)::BIGINT AS lancamentos, sum(valor * {SIGN_SQL})::BIGINT AS valor FROM snap GROUP BY ALL")
def movement_effects(spark, sf_dir):
    return movements(spark, sf_dir).groupBy("event_type", "efeito", "sinal").agg(F.count(F.lit(1)).alias("lancamentos"), F.sum(F.col("valor") * F.col("sinal")).cast("long").alias("valor"))


@query(f"""{SNAP_SQL}, m AS (SELECT user_id, ts, {EFFECT_SQL} AS efeito, valor * {SIGN_SQL} AS v FROM snap)
SELECT user_id, coalesce(sum(v) FILTER (ts < TIMESTAMP '2024-01-15'), 0)::BIGINT AS abertura, {", ".join(f"coalesce(sum(v) FILTER (ts >= TIMESTAMP '2024-01-15' AND efeito = '{e}'), 0)::BIGINT AS {e}" for e, _ in MOVEMENTS.values())}, coalesce(sum(v), 0)::BIGINT AS fechamento FROM m GROUP BY user_id""")
def movement_replay(spark, sf_dir):
    v = F.col("valor") * F.col("sinal")
    start = F.lit("2024-01-15 00:00:00").cast("timestamp")
    flows = [F.coalesce(F.sum(F.when((F.col("ts") >= start) & (F.col("efeito") == e), v)), F.lit(0)).cast("long").alias(e) for e, _ in MOVEMENTS.values()]
    return movements(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("ts") < start, v)), F.lit(0)).cast("long").alias("abertura"), *flows, F.sum(v).cast("long").alias("fechamento"))


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("documento"), cents(F.col("o_totalprice")).alias("valor"))


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("documento")).agg(F.sum(cents(F.col("l_extendedprice"))).cast("long").alias("valor"))


@query("""WITH c AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS documento, round(o_totalprice * 100)::BIGINT AS declarado, v AS calculado, (v - round(o_totalprice * 100)::BIGINT)::BIGINT AS diferenca,
 CASE WHEN v IS NULL THEN 'sem valor calculado' WHEN v = round(o_totalprice * 100)::BIGINT THEN 'sem diferença' ELSE 'diferença' END AS situacao FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def reconcile_columns(spark, sf_dir):
    return rec_ops.reconcile(_declared(spark, sf_dir), _computed(spark, sf_dir), ["documento"])


@query("SELECT o_orderkey AS documento, round(o_totalprice * 100)::BIGINT AS valor FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def reconcile_missing(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("documento"))
    return _declared(spark, sf_dir).join(lines, "documento", "left_anti")


#: Years, entity, column (NULL: any), text, certainty (2: explained, 1: hypothesis).
CATALOG = [([1996, 1997, 1998, 1999], None, "d", "cancelamento por categoria", 2), ([1998, 1999, 2000], 2, None, "entidade em revisão", 1), ([2000, 2001], None, "j", "regra de cancelamento", 2), ([1997], 3, "e", "fechamento manual", 1)]
DIFF_SQL = f"{STATEMENT_SQL}, df13 AS (SELECT a.entidade, a.ex, a.df, a.coluna, (b.valor - a.valor)::BIGINT AS diferenca FROM stm a JOIN stm b ON a.entidade = b.entidade AND a.ex = b.ex AND a.df = b.df AND a.coluna = b.coluna WHERE a.versao = 'v1' AND b.versao = 'v3')"
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
EXPLAIN_SQL = f"""{DIFF_SQL}, cat(anos, entidade, coluna, texto, certeza) AS (VALUES {", ".join(f"({a}, {_sql(e)}, {_sql(c)}, {_sql(t)}, {n})" for a, e, c, t, n in CATALOG)}),
ex1 AS (SELECT d.entidade, d.ex, d.df, d.coluna, d.diferenca, coalesce(string_agg(texto, '; ' ORDER BY texto), '') AS explicacao, max(certeza)::INT AS certeza
 FROM df13 d LEFT JOIN cat k ON list_contains(k.anos, d.ex) AND d.diferenca <> 0 AND (k.entidade IS NULL OR k.entidade = d.entidade) AND (k.coluna IS NULL OR k.coluna = d.coluna) GROUP BY ALL),
ex2 AS (SELECT *, CASE WHEN diferenca = 0 THEN 'sem diferença' WHEN certeza = 2 THEN 'explicada' WHEN certeza = 1 THEN 'hipótese' ELSE 'não determinada' END AS situacao FROM ex1)"""


def version_differences(spark: SparkSession, sf_dir: str, first: str = "v1", second: str = "v3") -> DataFrame:
    """second - first of every statement column, from one pass over both versions."""
    at = lambda v: F.max(F.when(F.col("versao") == v, F.col("valor")))
    return statement(spark, sf_dir, (first, second)).groupBy("entidade", "ex", "df", "coluna").agg((at(second) - at(first)).alias("diferenca"))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame(CATALOG, "anos array<bigint>, entidade bigint, coluna string, texto string, certeza int")
    return rec_ops.explain(version_differences(spark, sf_dir), catalog, ["entidade", "coluna"])


@query(f"{EXPLAIN_SQL} SELECT * FROM ex2")
def explanations_wildcard(spark, sf_dir):
    return _explained(spark, sf_dir)


@query(f"""{EXPLAIN_SQL}, n AS (SELECT entidade, ex, df, count(*) FILTER (situacao <> 'sem diferença')::BIGINT AS diferencas, count(*) FILTER (situacao = 'explicada')::BIGINT AS explicadas, count(*) FILTER (situacao = 'hipótese')::BIGINT AS hipoteses FROM ex2 GROUP BY ALL)
SELECT *, CASE WHEN diferencas = 0 THEN 'sem diferença' WHEN explicadas = diferencas THEN 'explicada' WHEN explicadas > 0 THEN 'parcialmente explicada' WHEN hipoteses > 0 THEN 'hipótese' ELSE 'não determinada' END AS situacao FROM n""")
def explanation_summary(spark, sf_dir):
    return rec_ops.summary(_explained(spark, sf_dir), ["entidade", "ex", "df"])


@query(f"""{STATEMENT_SQL}, l AS (SELECT entidade, ex, valor AS l FROM stm WHERE versao = 'v3' AND coluna = 'L' AND df LIKE '%-12-31'), o AS (SELECT entidade, ex, sum(valor)::BIGINT AS af FROM stm WHERE versao = 'v3' AND coluna IN ('a', 'f') AND df LIKE '%-04-30' GROUP BY ALL)
SELECT l.entidade, l.ex, l.l AS saldo, o.af AS abertura, (o.af - l.l)::BIGINT AS diferenca FROM l JOIN o ON o.entidade = l.entidade AND o.ex = l.ex + 1""")
def publication_consistency(spark, sf_dir):
    w = statement_columns(records(spark, sf_dir), ["entidade", "ex", "df"], ("v3",))
    close = w.where(F.col("df").endswith("-12-31")).select("entidade", "ex", F.col("L").alias("saldo"))
    nxt = w.where(F.col("df").endswith("-04-30")).select("entidade", (F.col("ex") - 1).alias("ex"), (F.col("a") + F.col("f")).alias("abertura"))
    return close.join(nxt, ["entidade", "ex"]).withColumn("diferenca", F.col("abertura") - F.col("saldo"))


@query(f"""{STATEMENT_SQL}, d AS (SELECT a.entidade, a.ex, a.df, a.coluna, (b.valor - a.valor)::BIGINT AS dif FROM stm a JOIN stm b ON a.entidade = b.entidade AND a.ex = b.ex AND a.df = b.df AND a.coluna = b.coluna WHERE a.versao = 'v2' AND b.versao = 'v3')
SELECT x.entidade, x.ex, x.df, x.coluna AS de, y.coluna AS para, x.dif AS valor FROM d x JOIN d y ON x.entidade = y.entidade AND x.ex = y.ex AND x.df = y.df AND (x.coluna, y.coluna) IN (('a', 'f'), ('b', 'g'), ('c', 'i'), ('d', 'j'), ('e', 'k')) WHERE x.dif <> 0 AND x.dif = -y.dif""")
def zero_sum_swaps(spark, sf_dir):
    return rec_ops.swaps(version_differences(spark, sf_dir, "v2", "v3"), ["entidade", "ex", "df"], [("a", "f"), ("b", "g"), ("c", "i"), ("d", "j"), ("e", "k")])


@query("""WITH g AS (SELECT n_nationkey::BIGINT AS nacao, n_regionkey::BIGINT AS regiao, y.ano FROM nation, (SELECT unnest(range(1995, 2003))::BIGINT AS ano) y),
c AS (SELECT c_nationkey AS nacao, year(o_orderdate) AS ano, count(*) AS c, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT regiao, CASE WHEN coalesce(c, 0) = 0 THEN 'nao_coletado' WHEN coalesce(r, 0) = 0 THEN 'coletado_sem_leitura' WHEN r < c THEN 'lido_parcial' ELSE 'lido' END AS s FROM g LEFT JOIN c ON g.nacao = c.nacao AND g.ano = c.ano)
SELECT regiao, count(*) FILTER (s = 'nao_coletado')::BIGINT AS nao_coletado, count(*) FILTER (s = 'coletado_sem_leitura')::BIGINT AS coletado_sem_leitura, count(*) FILTER (s = 'lido_parcial')::BIGINT AS lido_parcial, count(*) FILTER (s = 'lido')::BIGINT AS lido FROM s GROUP BY regiao""")
def coverage_matrix(spark, sf_dir):
    expected = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nacao"), F.col("n_regionkey").cast("long").alias("regiao"), F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2002).cast("long"))).alias("ano"))
    nation = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("nacao"))
    orders = read(spark, sf_dir, "orders").join(nation, "o_custkey").select("o_orderkey", "nacao", F.year("o_orderdate").cast("long").alias("ano"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda df: df.groupBy("nacao", "ano").agg(F.count(F.lit(1)).alias("n"))
    kinds = ["nao_coletado", "coletado_sem_leitura", "lido_parcial", "lido"]
    found = rec_ops.coverage(expected, count(orders), count(orders.join(lines, "o_orderkey", "left_semi")), ["nacao", "ano"])
    return found.groupBy("regiao").pivot("situacao", kinds).count().na.fill(0, kinds)


LIST = "entidade, ex, df, anoempenho, empenho, categoria, proc + aproc AS inscricao, s1"


@query(f"{RECORDS} SELECT {LIST} FROM rec WHERE ex = 1999 AND df = '1999-12-31' AND categoria = 'ambos' ORDER BY s1 DESC, entidade, anoempenho, empenho LIMIT 50 OFFSET 100")
def list_page(spark, sf_dir):
    rows = records(spark, sf_dir).where("ex = 1999 and df = '1999-12-31' and categoria = 'ambos'")
    return rows.selectExpr(*[c.strip() for c in LIST.split(",")]).orderBy(F.desc("s1"), "entidade", "anoempenho", "empenho").offset(100).limit(50)


@query("SELECT p_partkey, p_brand, p_type, round(p_retailprice * 100)::BIGINT AS preco FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size BETWEEN 1 AND 20")
def list_prefix_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1") & F.col("p_size").between(1, 20))
    return rows.select("p_partkey", "p_brand", "p_type", cents(F.col("p_retailprice")).alias("preco"))


@query(f"{RECORDS} SELECT ex, df, {ALL_SUMS} FROM rec WHERE categoria = 'ambos' AND starts_with(prioridade, '1') GROUP BY ALL")
def list_totals(spark, sf_dir):
    return indicators(records(spark, sf_dir).where((F.col("categoria") == "ambos") & F.col("prioridade").startswith("1")), ["ex", "df"])


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(lpad(c_custkey::VARCHAR, 14, '0'), '^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$', '\\1.\\2.\\3/\\4-\\5') WHEN c_custkey % 3 = 1 THEN '***' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '***' WHEN c_custkey % 2 = 0 THEN c_name END AS doc FROM customer)
SELECT CASE WHEN regexp_full_match(doc, '\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}') THEN 'pessoa jurídica' WHEN regexp_full_match(doc, '\\*+\\d{3}\\*+') OR length(regexp_replace(doc, '\\D', '', 'g')) = 11 THEN 'pessoa física' ELSE 'não identificado' END AS tipo,
 count(*)::BIGINT AS credores, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS saldo FROM c GROUP BY 1""")
def creditor_type_totals(spark, sf_dir):
    k = F.col("c_custkey")
    company = F.regexp_replace(F.lpad(k.cast("string"), 14, "0"), r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    person = F.concat(F.lit("***"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("***"))
    doc = F.when(k % 3 == 0, company).when(k % 3 == 1, person).when(k % 2 == 0, F.col("c_name"))
    return read(spark, sf_dir, "customer").groupBy(creditor_type(doc).alias("tipo")).agg(F.count(F.lit(1)).alias("credores"), F.sum(cents(F.col("c_acctbal"))).cast("long").alias("saldo"))


TYPES = ("LIQ-NEG", "PAGOPROC-SEM-PROC", "CANCPROC-NZ", "COPIA-24", "ANOEMP-FUTURO", "SEM-SALDO-ABERTURA", "CHAVE-DUP", "VALOR-RECUSADO", "COPIA-SEM-PAR", "PAR-INSCRICAO-DIVERGENTE", "PAR-EXECUCAO-DOIS-LADOS", "DESCONTINUIDADE", "SALDO-SEM-CONTINUIDADE")


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of records, and copies without a pair: the seven types of records and copies."""
    rec, base = records(spark, sf_dir), copy_base(spark, sf_dir)
    own = anomalies(rec, COPIES, base)
    lone = pair.unpaired(rec, COPIES, ORIGINALS, base, MATCH).select("entidade", "ex", "df", "anoempenho", "empenho", F.lit("COPIA-SEM-PAR").alias("tipo"))
    return own.unionByName(lone)


QUALITY_SQL = f"{PAIRS_SQL}, {ANOMALIES_SQL.split(', an AS', 1)[0].replace('half AS', 'half2 AS')}, an AS{ANOMALIES_SQL.split(', an AS', 1)[1].replace('FROM rec, half)', 'FROM rec, half2)')}, ms AS ({MISSING_SQL}), qa AS (SELECT entidade, ex, df, anoempenho, empenho, tipo FROM an UNION ALL SELECT entidade, ex, df, anoempenho, empenho, 'COPIA-SEM-PAR' FROM ms)"


def all_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of all TYPES, one row each: those of _anomalies and the other set anomalies.

    A repeated key of lines has its order's number and no cut-off; a record with refused values, one row whatever the number of its fields,
    has no cut-off either. Pairs count for the copy. A break between years counts at the opening, the latest cut-off of the year after, and only
    where the entity has one.
    """
    rec = records(spark, sf_dir)
    none, no_cut = F.lit(None).cast("long"), F.lit(None).cast("string")
    row = lambda entity, ex, df, year, number, kind: [entity.alias("entidade"), ex.alias("ex"), df.alias("df"), year.alias("anoempenho"), number.alias("empenho"), kind.alias("tipo")]
    c = F.col
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", "l_partkey", "l_suppkey").alias("content")).repartition(tasks(spark, sf_dir), "l_orderkey", "l_linenumber")
    repeated = val.repeated_keys(lines, ["l_orderkey", "l_linenumber"], c("content")).select(*row(none, none, no_cut, none, c("l_orderkey"), F.lit("CHAVE-DUP")))
    number = lambda n: F.try_variant_get("item", f"$.{n}", "bigint")
    items = contracts.items(pages(spark, sf_dir), ["pagina"]).withColumns({f"__{n}": number(n) for n in ("entidade", "anoempenho", "empenho")})
    refused = contracts.refused_values(items, ["pagina", "__entidade", "__anoempenho", "__empenho"]).drop("campo", "motivo", "bruto").distinct().select(*row(c("__entidade"), none, no_cut, c("__anoempenho"), c("__empenho"), F.lit("VALOR-RECUSADO")))
    kinds = F.array_compact(F.array(F.when(c("relacao") != "igual", "PAR-INSCRICAO-DIVERGENTE"), F.when(c("lado") == "ambos", "PAR-EXECUCAO-DOIS-LADOS")))
    paired = _pairs(spark, sf_dir).withColumn("tipo", F.explode(kinds)).select(*row(F.lit(COPIES).cast("long"), c("ex"), c("df"), c("anoempenho"), c("a_empenho"), c("tipo")))
    closing = rec.where(c("df").endswith("-12-31"))
    opening = closing.withColumn("ex", c("ex") - 1)
    key = ["entidade", "anoempenho", "empenho", "ex"]
    followed = closing.join(F.broadcast(opening.select("entidade", "ex").distinct()), ["entidade", "ex"], "left_semi")  # a row for each entity and year
    broken = ser.continuity(followed.repartition(tasks(spark, sf_dir), *key), opening, key).where(c("classe").isin("DESCONTINUIDADE", "SALDO-SEM-CONTINUIDADE"))
    broken = broken.select(*row(c("entidade"), c("ex") + 1, F.concat((c("ex") + 1).cast("string"), F.lit("-12-31")), c("anoempenho"), c("empenho"), c("classe")))
    return integ.union_all([_anomalies(spark, sf_dir), repeated, refused, paired, broken])


ALL_ANOMALIES_SQL = f"""{QUALITY_SQL}, cl AS (SELECT * FROM rec WHERE df LIKE '%-12-31'), br AS (
 SELECT c.entidade, c.ex + 1 AS ex, (c.ex + 1)::VARCHAR || '-12-31' AS df, c.anoempenho, c.empenho, CASE WHEN o.empenho IS NULL AND c.s1 <> 0 THEN 'SALDO-SEM-CONTINUIDADE' WHEN o.empenho IS NOT NULL AND NOT (o.proc = c.s3 AND o.aproc = c.s2) THEN 'DESCONTINUIDADE' END AS tipo
 FROM cl c LEFT JOIN cl o ON o.entidade = c.entidade AND o.anoempenho = c.anoempenho AND o.empenho = c.empenho AND o.ex = c.ex + 1 WHERE EXISTS (SELECT 1 FROM cl n WHERE n.entidade = c.entidade AND n.ex = c.ex + 1)),
qt AS (SELECT entidade, ex, df, anoempenho, empenho, tipo FROM qa UNION ALL SELECT NULL, NULL, NULL, NULL, l_orderkey, 'CHAVE-DUP' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT o_custkey % 5, NULL, NULL, year(o_orderdate), o_orderkey, 'VALOR-RECUSADO' FROM orders WHERE o_orderkey % 11 < 5
 UNION ALL SELECT {COPIES}, ex, df, anoempenho, a_empenho, 'PAR-INSCRICAO-DIVERGENTE' FROM pr WHERE relacao <> 'igual' UNION ALL SELECT {COPIES}, ex, df, anoempenho, a_empenho, 'PAR-EXECUCAO-DOIS-LADOS' FROM pr WHERE lado = 'ambos'
 UNION ALL SELECT * FROM br WHERE tipo IS NOT NULL)"""


PROFILE_SQL = f"{ALL_ANOMALIES_SQL} SELECT tipo, count(*)::BIGINT AS ocorrencias, count(DISTINCT df)::BIGINT AS cortes, coalesce(string_agg(DISTINCT ex::VARCHAR, ',' ORDER BY ex::VARCHAR), '') AS exercicios FROM qt GROUP BY tipo"
ABSENT_SQL = f"{ALL_ANOMALIES_SQL}, t(tipo) AS (VALUES {', '.join(f"('{t}')" for t in TYPES)}) SELECT tipo FROM t WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.tipo = t.tipo)"


@query(PROFILE_SQL)
def quality_profile(spark, sf_dir):
    """Occurrences, cut-offs and years of every type of anomaly that occurs, of records and of sets."""
    return all_anomalies(spark, sf_dir).groupBy("tipo").agg(F.count(F.lit(1)).alias("ocorrencias"), F.count_distinct("df").alias("cortes"), F.array_join(F.array_sort(F.collect_set(F.col("ex").cast("string"))), ",").alias("exercicios"))


@query(ABSENT_SQL)
def types_without_occurrence(spark, sf_dir):
    """Types of the catalog that were looked for, all of them, and not found."""
    types = spark.createDataFrame([(t,) for t in TYPES], "tipo string")
    return types.join(all_anomalies(spark, sf_dir).select("tipo").distinct(), "tipo", "left_anti")


@query(PROFILE_SQL)
def quality_profile_all(spark, sf_dir):
    return quality_profile(spark, sf_dir)


@query(ABSENT_SQL)
def types_without_occurrence_all(spark, sf_dir):
    return types_without_occurrence(spark, sf_dir)


@query(f"{EXPLAIN_SQL} SELECT coluna, {', '.join(f"count(*) FILTER (situacao = '{s}')::BIGINT AS {n}" for s, n in (('sem diferença', 'sem_diferenca'), ('explicada', 'explicada'), ('hipótese', 'hipotese'), ('não determinada', 'nao_determinada')))} FROM ex2 GROUP BY coluna")
def crosstab_situation(spark, sf_dir):
    names = {"sem diferença": "sem_diferenca", "explicada": "explicada", "hipótese": "hipotese", "não determinada": "nao_determinada"}
    return _explained(spark, sf_dir).groupBy("coluna").pivot("situacao", list(names)).count().na.fill(0).withColumnsRenamed(names)


RELATIONS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]


@query(" UNION ALL ".join(f"SELECT '{c}.{k} -> {p}' AS relacao, count(*)::BIGINT AS orfaos FROM {c} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {q} = {k})" for c, k, p, q in RELATIONS))
def orphans(spark, sf_dir):
    return integ.union_all([integ.orphans(read(spark, sf_dir, c), k, read(spark, sf_dir, p), q, f"{c}.{k} -> {p}") for c, k, p, q in RELATIONS])


@query("WITH x AS (SELECT event_id, unnest([(props->>'k')::BIGINT, (props->>'k')::BIGINT + 1]) AS k FROM events) SELECT n_name AS nome, count(*)::BIGINT AS ligacoes, count(DISTINCT event_id)::BIGINT AS eventos FROM x JOIN nation ON n_nationkey = k % 25 GROUP BY n_name")
def json_array_links(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.concat(F.lit("["), k.cast("string"), F.lit(","), (k + 1).cast("string"), F.lit("]"))
    links = read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(text, "array<bigint>")).alias("k"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("nome"))
    return links.join(nation, F.col("k") % 25 == F.col("n")).groupBy("nome").agg(F.count(F.lit(1)).alias("ligacoes"), F.count_distinct("event_id").alias("eventos"))


SITUATIONS = ("operacional", "experimental", "nao_recomendada")
DECISIONS_SQL = f"{SNAP_SQL}, dec AS (SELECT event_type || '/' || (user_id % 4)::VARCHAR AS regra, ts, em, uid, ([{', '.join(f"'{s}'" for s in SITUATIONS)}])[user_id % 3 + 1] AS situacao, user_id % 3 = 0 AS compoe FROM snap)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on rules."""
    u = F.col("user_id")
    return snapshots(spark, sf_dir).select(F.concat_ws("/", "event_type", (u % 4).cast("string")).alias("regra"), "ts", "em", "uid", F.element_at(F.array(*[F.lit(s) for s in SITUATIONS]), (u % 3 + 1).cast("int")).alias("situacao"), (u % 3 == 0).alias("compoe"))


@query(f"{DECISIONS_SQL} SELECT regra, arg_max(em, ts) AS em, arg_max(situacao, ts) AS situacao, arg_max(compoe, ts) AS compoe, count(*)::BIGINT AS decisoes FROM dec GROUP BY regra")
def governance_current(spark, sf_dir):
    return integ.decisions_as_of(decisions(spark, sf_dir), "regra", "ts", "uid", ["em", "situacao", "compoe"])


@query(f"{DECISIONS_SQL} SELECT regra, arg_max(em, ts) AS em, arg_max(situacao, ts) AS situacao, arg_max(compoe, ts) AS compoe, count(*)::BIGINT AS decisoes FROM dec WHERE ts <= TIMESTAMP '2024-01-15 23:59:59' GROUP BY regra")
def governance_asof(spark, sf_dir):
    return integ.decisions_as_of(decisions(spark, sf_dir), "regra", "ts", "uid", ["em", "situacao", "compoe"], F.lit("2024-01-15 23:59:59").cast("timestamp"))


@query("""WITH g AS (
SELECT 'valores não negativos' AS portao, count(*) FILTER (l_extendedprice < 0)::BIGINT AS falhas FROM lineitem UNION ALL SELECT 'centavos exatos', count(*) FILTER (abs(l_extendedprice * 100 - round(l_extendedprice * 100)) > 0.001)::BIGINT FROM lineitem
UNION ALL SELECT 'chave única', count(*)::BIGINT FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'pedidos com itens', count(*)::BIGINT FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'segunda leitura', NULL::BIGINT) SELECT portao, falhas, falhas = 0 AS ok FROM g""")
def gates(spark, sf_dir):
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    price = F.col("l_extendedprice")
    repeated = line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    empty = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    every = F.lit(True)
    return integ.union_all([
        integ.gate("valores não negativos", line, price < 0), integ.gate("centavos exatos", line, F.abs(price * 100 - F.round(price * 100)) > 0.001), integ.gate("chave única", repeated, every),
        integ.gate("pedidos com itens", empty, every), integ.gate("segunda leitura", read(spark, sf_dir, "region"), every, verified=False),
    ])


@query("SELECT c_nationkey::BIGINT AS nacao FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier")
def set_union(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nacao")).union(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()


@query("SELECT o_orderkey AS chave FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chave")).subtract(read(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("SELECT o_custkey AS chave FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("chave")).intersect(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("WITH r AS (SELECT c_nationkey::BIGINT AS nacao, c_custkey, md5('amostra:' || c_custkey::VARCHAR) AS h FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY nacao ORDER BY h, c_custkey) AS n FROM r) SELECT nacao, c_custkey, n::BIGINT AS posicao FROM k WHERE n <= 3")
def stratified_sample_hash(spark, sf_dir):
    h = F.md5(F.concat(F.lit("amostra:"), F.col("c_custkey").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("nacao").orderBy("h", "c_custkey"))
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nacao"), "c_custkey", h.alias("h")).withColumn("posicao", rank.cast("long")).where("posicao <= 3").drop("h")


@query("WITH p AS (SELECT unnest(json_keys(props)) AS chave, props FROM events) SELECT '$.' || chave AS caminho, 'BIGINT' AS tipos, count(*)::BIGINT AS registros, count(*) = (SELECT count(*) FROM events) AS obrigatorio FROM p WHERE json_type(props, '$.' || chave) IN ('UBIGINT', 'BIGINT') GROUP BY ALL")
def contract_shape(spark, sf_dir):
    return path_types(read(spark, sf_dir, "events"), "props")


@query("""WITH h AS (SELECT c_mktsegment, sha256('=' || c_custkey::VARCHAR || chr(31) || '=' || c_name || chr(31) || '=' || c_nationkey::VARCHAR || chr(31) || '=' || round(c_acctbal * 100)::BIGINT::VARCHAR) AS h FROM customer)
SELECT c_mktsegment, count(*)::BIGINT AS linhas, sha256(count(*)::VARCHAR || '/' || """ + " || '/' || ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR" for i in range(4)) + ") AS hash FROM h GROUP BY c_mktsegment")
def result_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("saldo", cents(F.col("c_acctbal")))
    return integ.table_hash(rows, ["c_custkey", "c_name", "c_nationkey", "saldo"], ["c_mktsegment"])


@query("""SELECT page_id, list_aggregate(list_transform(string_split(regexp_replace(url, '[/=&?.-]', ' ', 'g') || ' ' || (page_id * 1234567)::VARCHAR, ' '), lambda t: CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 6 OR (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 AND contains(t, '*')) THEN '***' ELSE t END), 'string_agg', ' ') AS url FROM pages""")
def mask_digits(spark, sf_dir):
    text = F.concat(F.regexp_replace("url", "[/=&?.-]", " "), F.lit(" "), (F.col("page_id") * 1234567).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", mask_tokens(text, 6).alias("url"))
