"""Indicators, breakdowns, compositions, statement columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import half_up_tenths, largest_remainder
from ..operators import indicators as ind
from ..operators.rules import CATEGORIES, COLUMNS, anomalies, derive, long_columns, statement_columns
from ..sources import ledger
from ..sources.ledger import CUTOFF, read
from ..sources.store import layer
from .registry import RECORDS, query

ALL_SUMS = """count(*)::BIGINT AS registros, sum(proc)::BIGINT AS inscricao_proc, sum(aproc)::BIGINT AS inscricao_aproc, sum(proc + aproc)::BIGINT AS inscricao,
 sum(pago_proc)::BIGINT AS pago_proc, sum(pago_aproc)::BIGINT AS pago_aproc, sum(pago_proc + pago_aproc)::BIGINT AS pagos, sum(pago_proc_estornado + pago_aproc_estornado)::BIGINT AS estornos, sum(liquidado)::BIGINT AS liquidado,
 sum(cancelado_aproc + cancelado_proc)::BIGINT AS cancelados, sum(retencao)::BIGINT AS retencao, sum(s1)::BIGINT AS s1, sum(s2)::BIGINT AS s2, sum(s3)::BIGINT AS s3"""
DIM = "count(*)::BIGINT AS registros, sum(proc + aproc)::BIGINT AS inscricao, sum(s1)::BIGINT AS s1"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, as a stored layer in partitions by fiscal year and cut-off."""
    sources = [f"{sf_dir}/{t}.parquet" for t in ledger.SOURCES]
    build = lambda: derive(ledger.at_cuts(ledger.dealt(ledger.balances(spark, sf_dir), ledger.portions(spark, sf_dir))))
    return layer(spark, "derivado", ledger.VERSION, sources, build, CUTOFF, ["entidade", "anoempenho", "empenho"], dealt=True)


@query(f"{RECORDS} SELECT entidade, ex, df, {ALL_SUMS} FROM rec GROUP BY ALL")
def ind_entity_cutoff(spark, sf_dir):
    return ind.indicators(records(spark, sf_dir), ["entidade", *CUTOFF])


@query(f"""{RECORDS}, m AS (SELECT ex, df, count(DISTINCT entidade) AS present, {ALL_SUMS} FROM rec GROUP BY ALL), q AS (SELECT count(DISTINCT r_regionkey) AS required FROM region)
SELECT ex, df, CASE WHEN present = required THEN 'com_dados' ELSE 'municipio_indisponivel' END AS situacao, (required - present)::BIGINT AS ausentes,
 {", ".join(f"CASE WHEN present = required THEN {n} END AS {n}" for n in ("registros", *ind.SUMS))} FROM m, q""")
def ind_municipality(spark, sf_dir):
    per = ind.indicators(records(spark, sf_dir), ["entidade", *CUTOFF])
    catalog = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("entidade"))
    return ind.only_if_all_present(per, catalog, CUTOFF, ["registros", *ind.SUMS])


@query(f"{RECORDS} SELECT entidade, ex, df, categoria, {DIM} FROM rec GROUP BY ALL")
def cat_breakdown(spark, sf_dir):
    return ind.by_dimension(records(spark, sf_dir), ["entidade", *CUTOFF], F.col("categoria"), "categoria")


BANDS = "SELECT ex, df, faixa_p AS faixa, proc AS v FROM rec WHERE faixa_p IS NOT NULL UNION ALL SELECT ex, df, faixa_n, aproc FROM rec WHERE faixa_n IS NOT NULL"


@query(f"{RECORDS}, x AS ({BANDS}) SELECT ex, df, faixa, count(*)::BIGINT AS registros, sum(v)::BIGINT AS inscricao FROM x GROUP BY ALL")
def band_breakdown(spark, sf_dir):
    return ind.bands(records(spark, sf_dir), CUTOFF)


@query(f"{RECORDS} SELECT ex, df, segmento, {DIM} FROM rec GROUP BY ALL")
def dim_segment(spark, sf_dir):
    return ind.by_dimension(records(spark, sf_dir), CUTOFF, F.col("segmento"), "segmento")


@query(f"{RECORDS} SELECT ex, df, prioridade, {DIM} FROM rec GROUP BY ALL")
def dim_priority(spark, sf_dir):
    return ind.by_dimension(records(spark, sf_dir), CUTOFF, F.col("prioridade"), "prioridade")


@query(f"{RECORDS} SELECT ex, df, CASE WHEN nacao % 5 <> 0 THEN nacao END AS nacao, {DIM} FROM rec GROUP BY ALL")
def dim_nation_null(spark, sf_dir):
    return ind.by_dimension(records(spark, sf_dir), CUTOFF, F.when(F.col("nacao") % 5 != 0, F.col("nacao")), "nacao")


@query(f"""{RECORDS}, p AS (SELECT DISTINCT ex, df FROM rec), d(categoria) AS (VALUES {", ".join(f"('{c}')" for c in CATEGORIES)}),
g AS (SELECT ex, df, categoria, {DIM} FROM rec GROUP BY ALL)
SELECT p.ex, p.df, d.categoria, coalesce(registros, 0)::BIGINT AS registros, coalesce(inscricao, 0)::BIGINT AS inscricao, coalesce(s1, 0)::BIGINT AS s1
FROM p CROSS JOIN d LEFT JOIN g ON g.ex = p.ex AND g.df = p.df AND g.categoria = d.categoria""")
def composition_fixed_groups(spark, sf_dir):
    found = ind.by_dimension(records(spark, sf_dir), CUTOFF, F.col("categoria"), "categoria")
    return ind.with_fixed_groups(found, spark, found, CUTOFF, "categoria", CATEGORIES, ["registros", "inscricao", "s1"])


@query(f"""{RECORDS}, t AS (SELECT ex, df, sum(proc + aproc)::BIGINT AS total FROM rec GROUP BY ALL),
x AS ({BANDS}), p AS (SELECT 'faixa' AS dimensao, ex, df, sum(v)::BIGINT AS partes FROM x GROUP BY ALL
 UNION ALL SELECT 'categoria', ex, df, sum(proc + aproc)::BIGINT FROM rec GROUP BY ALL UNION ALL SELECT 'segmento', ex, df, sum(proc + aproc)::BIGINT FROM rec GROUP BY ALL)
SELECT dimensao, p.ex, p.df, total, partes, partes = total AS fecha FROM p JOIN t ON p.ex = t.ex AND p.df = t.df""")
def closing_check(spark, sf_dir):
    rec = records(spark, sf_dir)
    total = ind.indicators(rec, CUTOFF)
    parts = {"faixa": ind.bands(rec, CUTOFF), "categoria": ind.by_dimension(rec, CUTOFF, F.col("categoria"), "g"), "segmento": ind.by_dimension(rec, CUTOFF, F.col("segmento"), "g")}
    out = None
    for name, found in parts.items():
        one = ind.closing(found, total, CUTOFF, "inscricao").withColumn("dimensao", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{RECORDS}, g AS (SELECT ex, df, entidade, sum(proc + aproc)::BIGINT AS inscricao FROM rec GROUP BY ALL),
f AS (SELECT *, (inscricao * 1000 // sum(inscricao) OVER w)::BIGINT AS fl, (inscricao * 1000 % sum(inscricao) OVER w)::BIGINT AS re FROM g WINDOW w AS (PARTITION BY ex, df)),
r AS (SELECT *, row_number() OVER (PARTITION BY ex, df ORDER BY re DESC, entidade) AS k, 1000 - sum(fl) OVER (PARTITION BY ex, df) AS miss FROM f)
SELECT ex, df, entidade, inscricao, (fl + CASE WHEN k <= miss THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def shares_largest_remainder(spark, sf_dir):
    groups = records(spark, sf_dir).groupBy(*CUTOFF, "entidade").agg(F.sum(F.col("proc") + F.col("aproc")).cast("long").alias("inscricao"))
    return largest_remainder(groups, CUTOFF, "inscricao", "entidade")


@query(f"""{RECORDS}, g AS (SELECT ex, df, nacao, sum(proc + aproc)::BIGINT AS inscricao FROM rec GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ex, df ORDER BY inscricao DESC, nacao) AS k, count(*) OVER (PARTITION BY ex, df) AS n FROM g)
SELECT ex, df, CASE WHEN n > 6 AND k > 5 THEN 'demais (' || (n - 5)::VARCHAR || ' grupos)' ELSE nacao::VARCHAR END AS grupo, sum(inscricao)::BIGINT AS inscricao, min(k)::BIGINT AS posicao FROM r GROUP BY ALL""")
def topk_with_rest(spark, sf_dir):
    groups = records(spark, sf_dir).groupBy(*CUTOFF, "nacao").agg(F.sum(F.col("proc") + F.col("aproc")).cast("long").alias("inscricao"))
    return ind.top_with_rest(groups, CUTOFF, "nacao", "inscricao", 5)


@query(f"""{RECORDS}, g AS (SELECT entidade, ex, df, sum(pago_proc + pago_aproc)::BIGINT AS pagos, sum(proc + aproc)::BIGINT AS inscricao FROM rec GROUP BY ALL)
SELECT *, CASE WHEN inscricao > 0 THEN ((2 * pagos * 1000 + inscricao) // (2 * inscricao))::BIGINT END AS decimos FROM g""")
def ratio_half_up(spark, sf_dir):
    got = ind.indicators(records(spark, sf_dir), ["entidade", *CUTOFF]).select("entidade", *CUTOFF, "pagos", "inscricao")
    return got.withColumn("decimos", half_up_tenths("pagos", "inscricao").cast("long"))


def _columns_sql(version: str) -> str:
    mixed = version != "v1"
    d, j = ("canc_v2_p", "canc_v2_n") if version == "v3" else ("canc_v1_p", "CASE WHEN aproc > 0 THEN cancelado_aproc ELSE 0 END")
    c2 = " + CASE WHEN proc > 0 AND aproc = 0 THEN pago_aproc ELSE 0 END" * mixed
    i2 = " + CASE WHEN aproc > 0 AND proc = 0 THEN pago_proc ELSE 0 END" * mixed
    return f"""SELECT entidade, ex, df, '{version}' AS versao, sum(CASE WHEN faixa_p = 'a' THEN proc ELSE 0 END) AS a, sum(CASE WHEN faixa_p = 'b' THEN proc ELSE 0 END) AS b,
 sum(CASE WHEN proc > 0 THEN pago_proc ELSE 0 END{c2}) AS c, sum({d}) AS d, sum(CASE WHEN faixa_n = 'f' THEN aproc ELSE 0 END) AS f, sum(CASE WHEN faixa_n = 'g' THEN aproc ELSE 0 END) AS g,
 sum(CASE WHEN aproc > 0 THEN liquidado ELSE 0 END) AS h, sum(CASE WHEN aproc > 0 THEN pago_aproc ELSE 0 END{i2}) AS i, sum({j}) AS j, sum(s1) AS t1, sum(s2) AS t2, sum(s3) AS t3 FROM rec GROUP BY ALL"""


def _long_sql(versions: tuple[str, ...]) -> str:
    values = {"e": "a + b - c - d", "k": "f + g - i - j", "L": "a + b - c - d + f + g - i - j", "S1": "t1", "S2": "t2", "S3": "t3"}
    parts = " UNION ALL ".join(f"SELECT entidade, ex, df, versao, '{c}' AS coluna, ({values.get(c, c)})::BIGINT AS valor FROM w" for c in COLUMNS)
    return f"{RECORDS}, w AS ({' UNION ALL '.join(_columns_sql(v) for v in versions)}), stm AS ({parts})"


STATEMENT_SQL = _long_sql(("v1", "v2", "v3"))


def statement(spark: SparkSession, sf_dir: str, versions: tuple[str, ...] = ("v1", "v2", "v3")) -> DataFrame:
    by = ["entidade", *CUTOFF]
    return long_columns(statement_columns(records(spark, sf_dir), by, versions), [*by, "versao"])


@query(f"{_long_sql(('v1',))} SELECT * FROM stm")
def statement_cols_v1(spark, sf_dir):
    return statement(spark, sf_dir, ("v1",))


@query(f"{_long_sql(('v2',))} SELECT * FROM stm")
def statement_cols_v2(spark, sf_dir):
    return statement(spark, sf_dir, ("v2",))


@query(f"{_long_sql(('v3',))} SELECT * FROM stm")
def statement_cols_v3(spark, sf_dir):
    return statement(spark, sf_dir, ("v3",))


@query(f"""{STATEMENT_SQL}, p AS (SELECT entidade, ex, df, versao, {", ".join(f"max(CASE WHEN coluna = '{c}' THEN valor END) AS x_{c}" for c in COLUMNS)} FROM stm GROUP BY ALL)
SELECT entidade, ex, df, versao, x_e = x_a + x_b - x_c - x_d AS e_ok, x_k = x_f + x_g - x_i - x_j AS k_ok, x_L = x_e + x_k AS l_ok, x_L = x_S1 AS l_s1, x_S1 = x_S2 + x_S3 AS s_ok FROM p""")
def statement_identities(spark, sf_dir):
    by = ["entidade", *CUTOFF, "versao"]
    p = statement(spark, sf_dir).groupBy(*by).pivot("coluna", list(COLUMNS)).agg(F.max("valor"))
    c = F.col
    return p.select(*by, (c("e") == c("a") + c("b") - c("c") - c("d")).alias("e_ok"), (c("k") == c("f") + c("g") - c("i") - c("j")).alias("k_ok"), (c("L") == c("e") + c("k")).alias("l_ok"), (c("L") == c("S1")).alias("l_s1"), (c("S1") == c("S2") + c("S3")).alias("s_ok"))


@query(f"{RECORDS} SELECT ex, entidade, sum(s1)::BIGINT AS s1, count(*)::BIGINT AS registros, grouping(entidade)::BIGINT AS nivel FROM rec WHERE df LIKE '%-12-31' GROUP BY ROLLUP (ex, entidade) HAVING grouping(ex) = 0")
def rollup_entity(spark, sf_dir):
    year_end = records(spark, sf_dir).where(F.col("df").endswith("-12-31"))
    return year_end.rollup("ex", "entidade").agg(F.sum("s1").cast("long").alias("s1"), F.count(F.lit(1)).alias("registros"), F.grouping("entidade").cast("long").alias("nivel"), F.grouping("ex").alias("g")).where("g = 0").drop("g")


@query(f"{RECORDS} SELECT ex, df, faixa_p, faixa_n, sum(proc)::BIGINT AS proc, sum(aproc)::BIGINT AS aproc FROM rec GROUP BY GROUPING SETS ((ex, df, faixa_p), (ex, df, faixa_n))")
def grouping_sets_band(spark, sf_dir):
    rec = records(spark, sf_dir)
    sets = [[F.col("ex"), F.col("df"), F.col("faixa_p")], [F.col("ex"), F.col("df"), F.col("faixa_n")]]
    return rec.groupingSets(sets, "ex", "df", "faixa_p", "faixa_n").agg(F.sum("proc").cast("long").alias("proc"), F.sum("aproc").cast("long").alias("aproc"))


#: Entity whose records from half of the key range on are copies of the next entity's.
COPIES, ORIGINALS = 0, 1
ANOMALIES_SQL = f"""half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), an AS (
 SELECT entidade, ex, df, anoempenho, empenho, unnest(list_filter([CASE WHEN liquidado < 0 THEN 'LIQ-NEG' END, CASE WHEN pago_proc <> 0 AND proc = 0 THEN 'PAGOPROC-SEM-PROC' END, CASE WHEN cancelado_proc <> 0 THEN 'CANCPROC-NZ' END,
 CASE WHEN entidade = {COPIES} AND empenho >= base_no THEN 'COPIA-24' END, CASE WHEN anoempenho >= ex THEN 'ANOEMP-FUTURO' END, CASE WHEN proc <= 0 AND aproc <= 0 THEN 'SEM-SALDO-ABERTURA' END], lambda x: x IS NOT NULL)) AS tipo FROM rec, half)"""


def copy_base(spark: SparkSession, sf_dir: str) -> int:
    """Half of the largest order key: one number, read from the column's statistics or a one-column scan."""
    return int(read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // 2


@query(f"{RECORDS}, {ANOMALIES_SQL} SELECT * FROM an")
def anomalies_per_record(spark, sf_dir):
    return anomalies(records(spark, sf_dir), COPIES, copy_base(spark, sf_dir))
