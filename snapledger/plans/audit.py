"""Resolution of cut-offs, official totals, hypotheses and the checks of the investigations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cutoffs
from ..operators.reconcile import scope_decision
from ..operators.rules import statement_columns
from ..sources.ledger import read
from ..sources.statements import column_groups
from ..sources.store import cut
from .history import GAP, POINTS_SQL, points
from .indicators import _columns_sql, records
from .registry import RECORDS, query

#: Not in the catalog; and what there was where no snapshot counts.
UNKNOWN = "(entidade = 4 AND ex = 2000)"
FLAGS = {"nao_processado": 0, "ambiguo": 1, "incompleto": 2}
STATES_SQL = f"""{POINTS_SQL}, st AS (SELECT p.entidade, p.ex, p.df, CASE WHEN p.entidade = 4 AND p.ex = 2000 THEN 'inexistente' WHEN g.s1 IS NOT NULL THEN 'com_dados'
 {" ".join(f"WHEN (p.entidade * 7 + p.ex) % 4 = {n} THEN '{f}'" for f, n in FLAGS.items())} ELSE 'sem_coleta' END AS situacao FROM pts p LEFT JOIN got g ON p.entidade = g.entidade AND p.ex = g.ex AND p.df = g.df)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every cut-off, from one count of the ledger: catalog, gap and attempts are columns of it. Written once a query, as it has a row for each cut-off and is used again and again."""
    every = records(spark, sf_dir).groupBy("entidade", "ex", "df").agg(F.count(F.lit(1)).alias("n"))
    attempt = lambda n: (F.col("entidade") * 7 + F.col("ex")) % 4 == n
    counted = F.when(~F.expr(GAP), F.col("n"))
    found = cutoffs.state(~F.expr(UNKNOWN), counted, {f: attempt(n) for f, n in FLAGS.items()})
    return cut(every.select("entidade", "ex", "df", found.alias("situacao"), counted.alias("registros")))


@query(f"{STATES_SQL} SELECT * FROM st")
def cutoff_states(spark, sf_dir):
    return states(spark, sf_dir).drop("registros")


@query(f"""{STATES_SQL}, n AS (SELECT ex, df, count(*) FILTER (situacao IN ('sem_rp', 'com_dados'))::BIGINT AS somadas, count(*) FILTER (situacao IN ('nao_processado', 'ambiguo', 'incompleto', 'sem_coleta'))::BIGINT AS faltam,
 count(*) FILTER (situacao = 'com_dados') AS com, coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade::VARCHAR) FILTER (situacao IN ('nao_processado', 'ambiguo', 'incompleto', 'sem_coleta')), '') AS ausentes FROM st GROUP BY ALL)
SELECT ex, df, CASE WHEN NOT (somadas > 0 AND faltam = 0) THEN 'municipio_indisponivel' WHEN com = 0 THEN 'sem_rp' ELSE 'com_dados' END AS situacao, somadas, faltam, ausentes FROM n""")
def cutoff_availability(spark, sf_dir):
    return cutoffs.availability(states(spark, sf_dir))


@query(f"""{STATES_SQL}, k AS (SELECT DISTINCT entidade, anoempenho, empenho FROM rec), h AS (
 SELECT k.entidade, st.ex, st.df, CASE WHEN st.situacao IN ('com_dados', 'sem_rp') AND r.s1 IS NULL THEN 'ausente' ELSE st.situacao END AS situacao, CASE WHEN st.situacao IN ('com_dados', 'sem_rp') THEN r.s1 END AS s1
 FROM k JOIN st ON k.entidade = st.entidade AND st.ex > k.anoempenho LEFT JOIN rec r ON r.entidade = k.entidade AND r.anoempenho = k.anoempenho AND r.empenho = k.empenho AND r.ex = st.ex AND r.df = st.df)
SELECT entidade, ex, df, situacao, count(*)::BIGINT AS empenhos, sum(s1)::BIGINT AS s1 FROM h GROUP BY ALL""")
def commitment_history(spark, sf_dir):
    rec, st = records(spark, sf_dir), states(spark, sf_dir)
    found = cutoffs.history(st.select("entidade", "ex", "df"), st, rec, ["entidade", "anoempenho", "empenho"], "s1")
    return found.groupBy("entidade", "ex", "df", "situacao").agg(F.count(F.lit(1)).alias("empenhos"), F.sum("s1").cast("long").alias("s1"))


@query(f"{STATES_SQL} SELECT st.*, p.s1, p.inscricao FROM st LEFT JOIN got p ON st.entidade = p.entidade AND st.ex = p.ex AND st.df = p.df AND st.situacao = 'com_dados'")
def entities_of_cutoff(spark, sf_dir):
    got = points(spark, sf_dir)[1].withColumn("situacao", F.lit("com_dados"))
    return states(spark, sf_dir).drop("registros").join(got, ["entidade", "ex", "df", "situacao"], "left")


@query(f"""{RECORDS}, w AS ({_columns_sql("v2")}), o AS (SELECT entidade, ex, df, nullif(a, 0) AS a, b, c, d, nullif(f, 0) AS f, g, i, j FROM w)
SELECT entidade, ex, df, (a + b + f + g)::BIGINT AS inscritos, (c + i)::BIGINT AS pagos, (d + j)::BIGINT AS cancelados, (coalesce(a, 0) + b - c - d + coalesce(f, 0) + g - i - j)::BIGINT AS saldo FROM o""")
def official_groups(spark, sf_dir):
    """Column groups of a statement whose zero inscriptions count as absent: a sum with an absent member is NULL."""
    w = statement_columns(records(spark, sf_dir), ["entidade", "ex", "df"], ("v2",)).withColumns({"a": F.nullif("a", F.lit(0)), "f": F.nullif("f", F.lit(0))})
    return column_groups(w).select("entidade", "ex", "df", "inscritos", "pagos", "cancelados", "saldo")


HYP_D = "CASE WHEN proc > 0 AND aproc = 0 THEN cancelado_aproc WHEN aproc > 0 AND proc > 0 AND cancelado_aproc > aproc THEN cancelado_aproc - aproc ELSE 0 END"
HYP_J = "CASE WHEN aproc > 0 AND proc > 0 AND cancelado_aproc > aproc THEN aproc WHEN aproc > 0 THEN cancelado_aproc ELSE 0 END"


@query(f"""{RECORDS} SELECT ex, df, sum({HYP_D})::BIGINT AS hipotese_d, sum({HYP_J})::BIGINT AS hipotese_j, sum(canc_v1_p)::BIGINT AS v1_d, sum(canc_v1_n)::BIGINT AS v1_j, (sum({HYP_D}) - sum(canc_v2_p))::BIGINT AS diferenca_d,
 (sum({HYP_J}) - sum(canc_v2_n))::BIGINT AS diferenca_j, count(*) FILTER (proc > 0 AND aproc > 0 AND cancelado_aproc > aproc)::BIGINT AS excedentes FROM rec GROUP BY ALL""")
def cancellation_hypothesis(spark, sf_dir):
    """Cancellation out of the not-processed balance first, only the excess out of the processed one; beside rule v1, and against rule v2."""
    proc, aproc, canc = F.col("proc"), F.col("aproc"), F.col("cancelado_aproc")
    over = (proc > 0) & (aproc > 0) & (canc > aproc)
    d = F.when((proc > 0) & (aproc == 0), canc).when(over, canc - aproc).otherwise(0)
    j = F.when(over, aproc).when(aproc > 0, canc).otherwise(0)
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return records(spark, sf_dir).groupBy("ex", "df").agg(
        total(d, "hipotese_d"), total(j, "hipotese_j"), total("canc_v1_p", "v1_d"), total("canc_v1_n", "v1_j"), total(d - F.col("canc_v2_p"), "diferenca_d"), total(j - F.col("canc_v2_n"), "diferenca_j"), F.count_if(over).alias("excedentes")
    )


@query(f"""{RECORDS}, p AS (SELECT entidade, anoempenho, empenho, ex, max(CASE WHEN df LIKE '%-04-30' THEN pago_proc + pago_aproc END) AS p1, max(CASE WHEN df LIKE '%-08-31' THEN pago_proc + pago_aproc END) AS p2, max(CASE WHEN df LIKE '%-12-31' THEN pago_proc + pago_aproc END) AS p3, max(proc + aproc) AS i1, min(proc + aproc) AS i2 FROM rec GROUP BY ALL)
SELECT entidade, ex, count(*)::BIGINT AS registros, count(*) FILTER (p1 <= p2 AND p2 <= p3)::BIGINT AS fluxo_cresce, count(*) FILTER (i1 = i2)::BIGINT AS abertura_constante FROM p GROUP BY ALL""")
def window_identities(spark, sf_dir):
    """Flows grow and openings stay from cut-off to cut-off of a year, counted per commitment."""
    paid = F.col("pago_proc") + F.col("pago_aproc")
    at = lambda md: F.max(F.when(F.col("df").endswith(md), paid))
    opened = F.col("proc") + F.col("aproc")
    p = records(spark, sf_dir).groupBy("entidade", "anoempenho", "empenho", "ex").agg(at("-04-30").alias("p1"), at("-08-31").alias("p2"), at("-12-31").alias("p3"), F.max(opened).alias("i1"), F.min(opened).alias("i2"))
    return p.groupBy("entidade", "ex").agg(F.count(F.lit(1)).alias("registros"), F.count_if((F.col("p1") <= F.col("p2")) & (F.col("p2") <= F.col("p3"))).alias("fluxo_cresce"), F.count_if(F.col("i1") == F.col("i2")).alias("abertura_constante"))


@query(f"{RECORDS} SELECT ex, count(*) FILTER (proc > 0 AND aproc <= 0)::BIGINT AS so_p, count(*) FILTER (aproc > 0 AND proc <= 0)::BIGINT AS so_n, count(*) FILTER (proc > 0 AND aproc > 0)::BIGINT AS ambos FROM rec WHERE df LIKE '%-12-31' GROUP BY ex")
def segments(spark, sf_dir):
    """Members of the processed and the not-processed tab, and of both: a full outer join of the tabs by key."""
    end = records(spark, sf_dir).where(F.col("df").endswith("-12-31"))
    key = ["entidade", "anoempenho", "empenho", "ex"]
    p, n = end.where("proc > 0").select(*key, F.lit(1).alias("p")), end.where("aproc > 0").select(*key, F.lit(1).alias("n"))
    both = p.join(n, key, "full")
    return both.groupBy("ex").agg(F.count_if(F.col("n").isNull()).alias("so_p"), F.count_if(F.col("p").isNull()).alias("so_n"), F.count_if(F.col("p").isNotNull() & F.col("n").isNotNull()).alias("ambos"))


#: The extra entity, the last year that the earlier rule includes it in, and statements of the inscription as they might be written (NULL: none).
EXTRA, UNTIL = 4, 1998
OFFICIAL = "CASE CAST(ex % 4 AS INT) WHEN 0 THEN outras + propria WHEN 1 THEN outras WHEN 2 THEN outras + {tenth} END"
PORTAL = "CASE WHEN ex % 3 = 0 THEN outras + propria WHEN ex % 3 = 1 THEN outras + 7 END"


@query(f"""{RECORDS}, e AS (SELECT ex, df, coalesce(sum(proc + aproc) FILTER (entidade = {EXTRA}), 0)::BIGINT AS propria, coalesce(sum(proc + aproc) FILTER (entidade <> {EXTRA}), 0)::BIGINT AS outras FROM rec GROUP BY ALL),
s AS (SELECT *, {OFFICIAL.format(tenth="propria // 40")} AS oficial, {PORTAL} AS portal FROM e),
c AS (SELECT *, CASE oficial - outras WHEN propria THEN 'inclui' WHEN 0 THEN 'exclui' END AS po, CASE portal - outras WHEN propria THEN 'inclui' WHEN 0 THEN 'exclui' END AS pp, CASE WHEN ex <= {UNTIL} THEN 'inclui' ELSE 'exclui' END AS regra,
 abs(oficial - outras) AS fora, abs(oficial - outras - propria) AS dentro FROM s)
SELECT ex, df, propria, outras, oficial::BIGINT AS oficial, portal::BIGINT AS portal, CASE WHEN po IS NOT NULL THEN po WHEN pp IS NOT NULL THEN pp WHEN oficial IS NOT NULL AND propria <> 0 AND 20 * least(fora, dentro) < propria THEN CASE WHEN fora < dentro THEN 'exclui' ELSE 'inclui' END ELSE regra END AS tratamento,
 CASE WHEN po IS NOT NULL AND pp IS NOT NULL AND po <> pp THEN 'contraditorio' WHEN po IS NOT NULL THEN 'comprovado' WHEN pp IS NOT NULL THEN 'comprovado pelo portal' WHEN oficial IS NOT NULL AND propria <> 0 AND 20 * least(fora, dentro) < propria THEN 'provavel' ELSE 'inconclusivo' END AS situacao FROM c""")
def scope_proof(spark, sf_dir):
    """Whether two statements' inscriptions prove that they include an extra entity, in the order of decision."""
    opened = F.col("proc") + F.col("aproc")
    part = lambda cond, n: F.coalesce(F.sum(F.when(cond, opened)), F.lit(0)).cast("long").alias(n)
    e = records(spark, sf_dir).groupBy("ex", "df").agg(part(F.col("entidade") == EXTRA, "propria"), part(F.col("entidade") != EXTRA, "outras"))
    e = e.withColumns({"oficial": F.expr(OFFICIAL.format(tenth="propria div 40")), "portal": F.expr(PORTAL)})
    treatment, situation = scope_decision(F.col("oficial"), F.col("portal"), F.col("propria"), F.col("outras"), UNTIL, F.col("ex"))
    return e.select("ex", "df", "propria", "outras", "oficial", "portal", treatment.alias("tratamento"), situation.alias("situacao"))


@query("WITH r AS (SELECT c_nationkey::BIGINT AS nacao, c_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS valor FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY nacao ORDER BY valor DESC, c_custkey) AS n FROM r) SELECT nacao, c_custkey, valor, n::BIGINT AS posicao FROM k WHERE n <= 10")
def creditors_top(spark, sf_dir):
    """The ten largest creditors of each nation (a top-k report)."""
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("valor"))
    named = orders.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nacao")), "c_custkey")
    rank = F.row_number().over(Window.partitionBy("nacao").orderBy(F.desc("valor"), "c_custkey"))
    return named.withColumn("posicao", rank.cast("long")).where("posicao <= 10").select("nacao", "c_custkey", "valor", "posicao")


CASES = {"maior saldo": "s1 > 1000000000", "só processado": "categoria = 'processado'", "só não processado": "categoria = 'nao_processado'", "cancelado": "cancelado_aproc > 0", "pago inteiro": "s1 = 0 AND proc + aproc > 0", "ano anterior": "anoempenho = ex - 1"}


@query(f"{RECORDS}, c AS ({' UNION ALL '.join(f"SELECT '{n}' AS caso, entidade, min(empenho) AS empenho FROM rec WHERE {p} GROUP BY entidade" for n, p in CASES.items())}) SELECT caso, entidade, empenho::BIGINT AS empenho FROM c")
def case_selection(spark, sf_dir):
    """For each predicate, the first commitment of each entity that meets it; one pass for all predicates."""
    firsts = records(spark, sf_dir).groupBy("entidade").agg(*[F.min(F.when(F.expr(p), F.col("empenho"))).alias(n) for n, p in CASES.items()])
    return firsts.unpivot(["entidade"], list(CASES), "caso", "empenho").where("empenho is not null")


LETTERS = list("abcdefghijkL")
_EXPR = {"e": "a + b - c - d", "k": "f + g - i - j", "L": "a + b - c - d + f + g - i - j"}


@query(f"""{RECORDS}, s AS ({" UNION ALL ".join(_columns_sql(v) for v in ("v1", "v2", "v3"))}), l AS (SELECT ex, df, versao, {", ".join(f"sum({_EXPR.get(c, c)}) AS x{i}" for i, c in enumerate(LETTERS))} FROM s GROUP BY ALL)
SELECT x.ex, x.df, x.versao AS versao_a, y.versao AS versao_b, ({" + ".join(f"(x.x{i} = y.x{i})::INT" for i in range(12))})::BIGINT AS iguais FROM l x JOIN l y ON x.ex = y.ex AND x.df = y.df AND x.versao < y.versao""")
def concordance_matrix(spark, sf_dir):
    """How many of the twelve columns two aggregation versions agree in, for each pair of versions and cut-off."""
    w = statement_columns(records(spark, sf_dir), ["ex", "df"])
    wide = w.groupBy("ex", "df").pivot("versao", ["v1", "v2", "v3"]).agg(F.first(F.struct(*LETTERS)))
    same = lambda a, b: sum(((F.col(f"{a}.{n}") == F.col(f"{b}.{n}")).cast("long") for n in LETTERS[1:]), (F.col(f"{a}.a") == F.col(f"{b}.a")).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("versao_a"), F.lit(b).alias("versao_b"), same(a, b).alias("iguais")) for a, b in (("v1", "v2"), ("v1", "v3"), ("v2", "v3"))]))
    return wide.select("ex", "df", each.alias("x")).select("ex", "df", "x.*")
