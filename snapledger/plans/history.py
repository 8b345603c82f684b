"""Snapshots as they were, series, and variation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import series as ser
from ..operators import validity as val
from ..operators import variation as var
from ..operators.indicators import indicators
from ..operators.rules import statement_columns
from ..sources.ledger import read, tasks
from .indicators import _columns_sql, records
from .registry import RECORDS, query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
INSTANTS = ("2024-01-10 23:59:59", "2024-01-20 23:59:59", "2024-01-30 23:59:59")
SNAP_SQL = "WITH snap AS (SELECT user_id, event_id AS uid, event_type, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS em, round(value * 100)::BIGINT AS valor, event_type = 'error' AS bad FROM events)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of their user's cut-off; an error is a refused one."""
    return read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("uid"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", STAMP).alias("em"), cents(F.col("value")).alias("valor"), (F.col("event_type") == "error").alias("bad"))


@query(f"{SNAP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, uid DESC) AS k FROM snap WHERE NOT bad) SELECT user_id, uid, em, valor FROM r WHERE k = 1")
def snapshot_current(spark, sf_dir):
    return val.current(snapshots(spark, sf_dir), ["user_id"], ["ts", "uid"], ["uid", "em", "valor"], ~F.col("bad"))


@query(f"""{SNAP_SQL}, i(inst) AS (VALUES {", ".join(f"(TIMESTAMP '{i}')" for i in INSTANTS)}),
r AS (SELECT inst, user_id, uid, em, valor, row_number() OVER (PARTITION BY inst, user_id ORDER BY ts DESC, uid DESC) AS k FROM snap JOIN i ON ts <= inst WHERE NOT bad)
SELECT strftime(inst, '%Y-%m-%d %H:%M:%S') AS instante, user_id, uid, em, valor FROM r WHERE k = 1""")
def snapshot_asof(spark, sf_dir):
    instants = spark.createDataFrame([(i,) for i in INSTANTS], "t string").select(F.to_timestamp("t").alias("em"))
    good = snapshots(spark, sf_dir).where(~F.col("bad")).withColumnRenamed("em", "quando")
    found = val.as_of(good, instants, ["user_id"], "ts", ["ts", "uid"], ["uid", "quando", "valor"])
    return found.select(F.date_format("em", "yyyy-MM-dd HH:mm:ss").alias("instante"), "user_id", "uid", F.col("quando").alias("em"), "valor")


@query(f"""{SNAP_SQL}, n AS (SELECT user_id, arg_max(uid, ts) AS mais_novo, arg_max(bad, ts) AS b, arg_max(uid, ts) FILTER (NOT bad) AS vigente FROM snap GROUP BY user_id)
SELECT user_id, mais_novo, vigente FROM n WHERE b""")
def snapshot_newest_refused(spark, sf_dir):
    return val.newest_refused(snapshots(spark, sf_dir), ["user_id"], ["ts", "uid"], "uid", F.col("bad"))


@query(f"{SNAP_SQL} SELECT user_id, uid, em, valor, lag(valor) OVER w AS anterior, (valor - lag(valor) OVER w)::BIGINT AS diferenca FROM snap WHERE NOT bad WINDOW w AS (PARTITION BY user_id ORDER BY ts, uid)")
def snapshot_prev_diff(spark, sf_dir):
    good = snapshots(spark, sf_dir).where(~F.col("bad"))
    return val.with_previous(good, ["user_id"], ["ts", "uid"], "valor").select("user_id", "uid", "em", "valor", "anterior", "diferenca")


@query(f"{SNAP_SQL} SELECT user_id, event_type, count(*)::BIGINT AS retratos, min(em) AS primeiro, max(em) AS ultimo FROM snap GROUP BY ALL HAVING count(*) > 1")
def multi_snapshot_having(spark, sf_dir):
    return snapshots(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("retratos"), F.min("em").alias("primeiro"), F.max("em").alias("ultimo")).where("retratos > 1")


@query(f"""{SNAP_SQL}, p AS (SELECT user_id, uid, ts, em, valor, lead(uid) OVER w AS uid2, lead(em) OVER w AS em2, lead(valor) OVER w AS valor2 FROM snap WHERE NOT bad WINDOW w AS (PARTITION BY user_id ORDER BY ts, uid))
SELECT user_id, uid, uid2, em, em2, (valor2 - valor)::BIGINT AS diferenca, DATE '2024-01-01' + (user_id % 30)::INT < ts::DATE AS retrospectiva FROM p WHERE uid2 IS NOT NULL AND valor2 <> valor""")
def retro_changes(spark, sf_dir):
    """Changes from each snapshot to the next of its cut-off; retrospective where the period had ended (here on a day of the user's) before the earlier one was taken."""
    w = Window.partitionBy("user_id").orderBy("ts", "uid")
    good = snapshots(spark, sf_dir).where(~F.col("bad"))
    pairs = good.withColumns({"uid2": F.lead("uid").over(w), "em2": F.lead("em").over(w), "valor2": F.lead("valor").over(w)}).where("uid2 is not null and valor2 <> valor")
    ended = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 30).cast("int"))
    return pairs.select("user_id", "uid", "uid2", "em", "em2", (F.col("valor2") - F.col("valor")).alias("diferenca"), (ended < F.to_date("ts")).alias("retrospectiva"))


#: The last snapshot that processing has seen, as an instant; and the present.
PROCESSED, NOW = "2024-01-25 23:59:59", "2024-02-01"


@query(f"{SNAP_SQL} SELECT event_type, max(em) FILTER (NOT bad) AS ultimo, date_diff('day', max(ts) FILTER (NOT bad)::DATE, DATE '{NOW}')::BIGINT AS dias, count(*) FILTER (ts > TIMESTAMP '{PROCESSED}')::BIGINT AS pendentes FROM snap GROUP BY event_type".replace("max(ts) FILTER (NOT bad)::DATE", "(max(ts) FILTER (NOT bad))::DATE"))
def freshness(spark, sf_dir):
    """Newest complete snapshot of each type, its age in days, and how many are stored but not processed yet."""
    good = lambda c: F.max(F.when(~F.col("bad"), F.col(c)))
    waiting = F.count_if(F.col("ts") > F.lit(PROCESSED).cast("timestamp"))
    return snapshots(spark, sf_dir).groupBy("event_type").agg(good("em").alias("ultimo"), F.datediff(F.lit(NOW).cast("date"), F.to_date(good("ts"))).cast("long").alias("dias"), waiting.alias("pendentes"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS vezes, count(DISTINCT l_partkey::VARCHAR || '/' || l_suppkey::VARCHAR)::BIGINT AS conteudos,
CASE WHEN count(DISTINCT l_partkey::VARCHAR || '/' || l_suppkey::VARCHAR) = 1 THEN 'exata' ELSE 'conflitante' END AS tipo FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_key_classified(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return val.repeated_keys(lines, ["l_orderkey", "l_linenumber"], F.concat_ws("/", "l_partkey", "l_suppkey"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)::BIGINT AS ocorrencia FROM lineitem")
def dup_occurrence(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return val.occurrences(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


#: Cut-offs that count as not collected, so that series have gaps and some years end early.
GAP = "((df LIKE '%-08-31' AND (entidade + ex) % 4 = 0) OR (df LIKE '%-12-31' AND (entidade + ex) % 3 = 0))"
POINTS_SQL = f"{RECORDS}, pts AS (SELECT entidade, ex, df, sum(s1)::BIGINT AS s1, sum(proc + aproc)::BIGINT AS inscricao FROM rec GROUP BY ALL), got AS (SELECT * FROM pts WHERE NOT {GAP})"


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = indicators(records(spark, sf_dir), ["entidade", "ex", "df"]).select("entidade", "ex", "df", "s1", "inscricao")
    return every, every.where(f"NOT {GAP}")


@query(f"{POINTS_SQL} SELECT p.entidade, p.ex, p.df, g.s1, CASE WHEN g.s1 IS NULL THEN 'sem_coleta' ELSE 'com_dados' END AS situacao, (g.s1 - lag(g.s1) OVER (PARTITION BY p.entidade, p.ex ORDER BY p.df))::BIGINT AS diferenca FROM pts p LEFT JOIN got g ON p.entidade = g.entidade AND p.ex = g.ex AND p.df = g.df")
def series_in_year(spark, sf_dir):
    every, got = points(spark, sf_dir)
    return ser.series(every.select("entidade", "ex", "df"), got, ["entidade", "ex"], ["df"], "s1")


@query(f"{POINTS_SQL} SELECT p.entidade, p.ex, p.df, g.inscricao, CASE WHEN g.inscricao IS NULL THEN 'sem_coleta' ELSE 'com_dados' END AS situacao, (g.inscricao - lag(g.inscricao) OVER (PARTITION BY p.entidade ORDER BY p.ex, p.df))::BIGINT AS diferenca FROM pts p LEFT JOIN got g ON p.entidade = g.entidade AND p.ex = g.ex AND p.df = g.df")
def series_adjacent_diff(spark, sf_dir):
    every, got = points(spark, sf_dir)
    return ser.series(every.select("entidade", "ex", "df"), got, ["entidade"], ["ex", "df"], "inscricao")


REP_SQL = f"{POINTS_SQL}, rep AS (SELECT entidade, ex, arg_max(df, (df LIKE '%-12-31')::INT::VARCHAR || df) AS df FROM got GROUP BY ALL)"


@query(f"{REP_SQL} SELECT * FROM rep")
def representative_cutoff(spark, sf_dir):
    return ser.representative(points(spark, sf_dir)[1], ["entidade", "ex"])


@query(f"""{REP_SQL}, g AS (SELECT DISTINCT entidade, y.ex FROM pts, (SELECT unnest(range(1995, 2004))::BIGINT AS ex) y),
v AS (SELECT r.entidade, r.ex, r.df, s1 FROM rep r JOIN got USING (entidade, ex, df))
SELECT g.entidade, g.ex, v.df, v.s1, CASE WHEN v.s1 IS NULL THEN 'sem_coleta' ELSE 'com_dados' END AS situacao, (v.s1 - lag(v.s1) OVER (PARTITION BY g.entidade ORDER BY g.ex))::BIGINT AS diferenca FROM g LEFT JOIN v ON g.entidade = v.entidade AND g.ex = v.ex""")
def series_across_years_dense(spark, sf_dir):
    every, got = points(spark, sf_dir)
    chosen = ser.representative(got, ["entidade", "ex"]).join(got, ["entidade", "ex", "df"])
    out = ser.series(ser.dense_years(every, ["entidade"], 1995, 2003), chosen, ["entidade"], ["ex"], "s1")
    return out.join(chosen.select("entidade", "ex", "df"), ["entidade", "ex"], "left")


@query(f"""{RECORDS}, w AS ({_columns_sql("v2")}), c AS (SELECT entidade, ex, t1 FROM w WHERE df LIKE '%-12-31'), o AS (SELECT entidade, ex, a + f AS af FROM w WHERE df LIKE '%-04-30')
SELECT c.entidade, c.ex, t1::BIGINT AS s1, af::BIGINT AS abertura, (af - t1)::BIGINT AS diferenca FROM c LEFT JOIN o ON o.entidade = c.entidade AND o.ex = c.ex + 1""")
def closing_vs_opening(spark, sf_dir):
    w = statement_columns(records(spark, sf_dir), ["entidade", "ex", "df"], ("v2",))
    closing = w.where(F.col("df").endswith("-12-31")).select("entidade", "ex", F.col("S1").alias("s1"))
    opening = w.where(F.col("df").endswith("-04-30")).select("entidade", (F.col("ex") - 1).alias("ex"), (F.col("a") + F.col("f")).alias("abertura"))
    return closing.join(opening, ["entidade", "ex"], "left").withColumn("diferenca", F.col("abertura") - F.col("s1"))


@query(f"""{RECORDS}, c AS (SELECT * FROM rec WHERE df LIKE '%-12-31'), o AS (SELECT * FROM rec WHERE df LIKE '%-04-30'),
j AS (SELECT c.ex, c.s1, CASE WHEN o.empenho IS NULL AND c.s1 <> 0 THEN 'SALDO-SEM-CONTINUIDADE' WHEN o.empenho IS NULL THEN 'encerrado' WHEN o.proc = c.s3 AND o.aproc = c.s2 THEN 'continuo' ELSE 'DESCONTINUIDADE' END AS classe
 FROM c LEFT JOIN o ON o.entidade = c.entidade AND o.anoempenho = c.anoempenho AND o.empenho = c.empenho AND o.ex = c.ex + 1)
SELECT ex, classe, count(*)::BIGINT AS registros, sum(s1)::BIGINT AS s1 FROM j GROUP BY ALL""")
def continuity(spark, sf_dir):
    rec = records(spark, sf_dir)
    closing = rec.where(F.col("df").endswith("-12-31"))
    opening = rec.where(F.col("df").endswith("-04-30")).withColumn("ex", F.col("ex") - 1)
    key = ["entidade", "anoempenho", "empenho", "ex"]
    found = ser.continuity(closing.repartition(tasks(spark, sf_dir), *key), opening, key)
    return found.groupBy("ex", "classe").agg(F.count(F.lit(1)).alias("registros"), F.sum("s1").cast("long").alias("s1"))


VAR_SQL = f"""{RECORDS}, va AS (SELECT entidade, anoempenho, empenho, ex + 1 AS ex, s1 FROM rec WHERE df LIKE '%-12-31'), vb AS (SELECT entidade, anoempenho, empenho, ex, s1 FROM rec WHERE df LIKE '%-12-31'),
vc AS (SELECT coalesce(va.entidade, vb.entidade) AS entidade, coalesce(va.anoempenho, vb.anoempenho) AS anoempenho, coalesce(va.empenho, vb.empenho) AS empenho, coalesce(va.ex, vb.ex)::BIGINT AS ex, va.s1 AS antes, vb.s1 AS depois,
 CASE WHEN va.s1 IS NULL THEN 'nova' WHEN vb.s1 IS NULL THEN 'retirada' WHEN vb.s1 > va.s1 THEN 'aumentou' WHEN vb.s1 < va.s1 THEN 'reduziu' ELSE 'igual' END AS classe, (coalesce(vb.s1, 0) - coalesce(va.s1, 0))::BIGINT AS contribuicao
 FROM va FULL JOIN vb ON va.entidade = vb.entidade AND va.anoempenho = vb.anoempenho AND va.empenho = vb.empenho AND va.ex = vb.ex)"""
KEY = ["entidade", "anoempenho", "empenho"]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year's end against the end of the year before."""
    end = records(spark, sf_dir).where(F.col("df").endswith("-12-31")).select(*KEY, "ex", "s1")
    return var.contributions(end.withColumn("ex", F.col("ex") + 1).repartition(tasks(spark, sf_dir), *KEY, "ex"), end, [*KEY, "ex"], "s1")


@query(f"{VAR_SQL} SELECT * FROM vc")
def variation_contrib(spark, sf_dir):
    return changes(spark, sf_dir)


@query(f"{VAR_SQL} SELECT ex, entidade, classe, count(*)::BIGINT AS registros, sum(contribuicao)::BIGINT AS soma FROM vc GROUP BY ALL")
def variation_classes(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("ex", "entidade", "classe").agg(F.count(F.lit(1)).alias("registros"), F.sum("contribuicao").cast("long").alias("soma"))


@query(f"""{VAR_SQL}, r AS (SELECT *, sign(contribuicao) AS sg, row_number() OVER (PARTITION BY ex, entidade, sign(contribuicao) ORDER BY abs(contribuicao) DESC, anoempenho, empenho) AS k FROM vc)
SELECT ex, entidade, CASE WHEN sg = 0 THEN 'sem variação' WHEN sg > 0 AND k <= 5 THEN 'maiores aumentos' WHEN sg > 0 THEN 'outros aumentos' WHEN k <= 5 THEN 'maiores reduções' ELSE 'outras reduções' END AS grupo,
 count(*)::BIGINT AS registros, sum(contribuicao)::BIGINT AS soma FROM r GROUP BY ALL""")
def variation_groups(spark, sf_dir):
    return var.groups(changes(spark, sf_dir), ["ex", "entidade"], ["anoempenho", "empenho"], 5)


@query(f"""{VAR_SQL}, r AS (SELECT *, row_number() OVER w AS posicao, sum(contribuicao) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acumulado, count(*) OVER (PARTITION BY ex, entidade) AS n
 FROM vc WHERE contribuicao <> 0 WINDOW w AS (PARTITION BY ex, entidade ORDER BY contribuicao DESC, anoempenho, empenho))
SELECT ex, entidade, anoempenho, empenho, contribuicao, posicao::BIGINT AS posicao, acumulado::BIGINT AS acumulado, ((posicao - 1) // 50)::BIGINT AS pagina,
 sum(contribuicao) OVER (PARTITION BY ex, entidade, (posicao - 1) // 50)::BIGINT AS subtotal, ((posicao - 1) // 50 + 1) * 50 >= n AS ultima FROM r""")
def variation_running_total(spark, sf_dir):
    out = var.ranked(changes(spark, sf_dir), ["ex", "entidade"], ["anoempenho", "empenho"], 50)
    return out.select("ex", "entidade", "anoempenho", "empenho", "contribuicao", "posicao", "acumulado", "pagina", "subtotal", "ultima")


FIELDS = ["proc", "aproc", "pago_proc", "pago_aproc", "cancelado_aproc", "liquidado", "retencao", "s1"]
DIFF_SQL = f"""{RECORDS}, da AS (SELECT *, ex + 1 AS ex1 FROM rec WHERE df LIKE '%-12-31'), dd AS (
 {" UNION ALL ".join(f"SELECT coalesce(a.entidade, b.entidade) AS entidade, coalesce(a.anoempenho, b.anoempenho) AS anoempenho, coalesce(a.empenho, b.empenho) AS empenho, coalesce(a.ex1, b.ex)::BIGINT AS ex, '{f}' AS campo, a.{f} AS antes, b.{f} AS depois, CASE WHEN a.ex IS NULL THEN 'novo' WHEN b.ex IS NULL THEN 'removido' ELSE 'alterado' END AS tipo FROM da a FULL JOIN da b ON a.entidade = b.entidade AND a.anoempenho = b.anoempenho AND a.empenho = b.empenho AND a.ex1 = b.ex WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS)})"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = records(spark, sf_dir).where(F.col("df").endswith("-12-31")).select(*KEY, "ex", *FIELDS)
    return var.differing_fields(end.withColumn("ex", F.col("ex") + 1), end, [*KEY, "ex"], FIELDS)


@query(f"{DIFF_SQL} SELECT * FROM dd")
def snapshot_diff_fields(spark, sf_dir):
    return differences(spark, sf_dir)


@query(f"""{DIFF_SQL}, e AS (SELECT *, coalesce(depois, 0) - coalesce(antes, 0) AS d FROM dd)
SELECT ex, campo, count(*)::BIGINT AS registros, coalesce(sum(d) FILTER (tipo = 'novo'), 0)::BIGINT AS novos, coalesce(sum(d) FILTER (tipo = 'removido'), 0)::BIGINT AS removidos, coalesce(sum(d) FILTER (tipo = 'alterado'), 0)::BIGINT AS alterados, sum(d)::BIGINT AS impacto FROM e GROUP BY ALL""")
def impact_by_field(spark, sf_dir):
    return var.impact(differences(spark, sf_dir), ["ex"])
