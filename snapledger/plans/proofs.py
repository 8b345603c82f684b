"""Differences taken apart, derivation as of an instant, and proofs about what is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import hashtree, intervals, residual
from ..operators.rules import statement_columns
from ..sources import refresh, staging
from ..sources.ledger import CUTOFF, read
from ..sources.store import layer, shared_folder
from .history import INSTANTS, SNAP_SQL, snapshots
from .indicators import _columns_sql, records
from .registry import RECORDS, query

POINT = ["entidade", "ex", "df"]
#: Columns that are compared, and those that pair up across the two blocks.
CELLS = ("a", "b", "c", "d", "e", "f", "g", "i", "j", "k", "L")
PAIRS = [("a", "f"), ("b", "g"), ("c", "i"), ("d", "j"), ("e", "k")]
#: Causes in order, as what they add to the closed columns: the payments that follow a record's only balance, known for the commitments of the year before alone; and the
#: split of the cancellation, known to have changed from this year on.
PAID, SPLIT, SPLIT_FROM = "pagamento segue o saldo", "cancelamento por saldo", 1998
_SIGNS = {"c": {"c": 1}, "d": {"d": 1}, "e": {"c": -1, "d": -1}, "i": {"i": 1}, "j": {"j": 1}, "k": {"i": -1, "j": -1}, "L": {"c": -1, "d": -1, "i": -1, "j": -1}}


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, coluna, ordem, causa, valor): what each cause adds to each cell, from the records themselves."""
    last, only_p, only_n = F.col("anoempenho") == F.col("ex") - 1, (F.col("proc") > 0) & (F.col("aproc") == 0), (F.col("aproc") > 0) & (F.col("proc") == 0)
    since = F.col("ex") >= SPLIT_FROM
    total = lambda cond, v, n: F.sum(F.when(cond, v).otherwise(0)).cast("long").alias(n)
    p = records(spark, sf_dir).groupBy(*POINT).agg(
        total(last & only_p, F.col("pago_aproc"), "c1"), total(last & only_n, F.col("pago_proc"), "i1"),
        total(since, F.col("canc_v2_p") - F.col("canc_v1_p"), "d2"), total(since, F.col("canc_v2_n") - F.when(F.col("aproc") > 0, F.col("cancelado_aproc")).otherwise(0), "j2"),
    )
    own = {1: {"c": "c1", "i": "i1"}, 2: {"d": "d2", "j": "j2"}}
    amount = lambda k, col: sum((F.col(own[k][c]) * s for c, s in _SIGNS[col].items() if c in own[k]), F.lit(0).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(col).alias("coluna"), F.lit(k).alias("ordem"), F.lit(name).alias("causa"), amount(k, col).alias("valor")) for col in _SIGNS for k, name in ((1, PAID), (2, SPLIT))]))
    return p.select(*POINT, each.alias("x")).select(*POINT, "x.*")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = statement_columns(records(spark, sf_dir), POINT, ("v1", "v3")).unpivot([*POINT, "versao"], list(CELLS), "coluna", "valor")
    at = lambda v: F.max(F.when(F.col("versao") == v, F.col("valor")))
    cells = wide.groupBy(*POINT, "coluna").agg((at("v3") - at("v1")).alias("diferenca"))
    cells = residual.cancelled_by_pair(cells, POINT, "coluna", "diferenca", PAIRS)
    causes = residual.gathered(_known(spark, sf_dir), [*POINT, "coluna"], "ordem", "causa", "valor")
    return residual.classify(cells, causes, [*POINT, "coluna"], "diferenca", "trocada")


def _cause_sql(k: int) -> str:
    own = {1: {"c": "c1", "i": "i1"}, 2: {"d": "d2", "j": "j2"}}[k]
    return "CASE coluna " + " ".join(f"WHEN '{col}' THEN {' + '.join(f'({s}) * {own[c]}' for c, s in signs.items() if c in own) or '0'}" for col, signs in _SIGNS.items()) + " ELSE 0 END"


#: Each cause taken in turn where it brings what is left nearer to zero; then the class.
RESIDUAL_SQL = f"""{RECORDS}, w1 AS ({_columns_sql("v1")}), w3 AS ({_columns_sql("v3")}),
x AS (SELECT *, a + b - c - d AS e, f + g - i - j AS k, a + b - c - d + f + g - i - j AS L FROM w1), y AS (SELECT *, a + b - c - d AS e, f + g - i - j AS k, a + b - c - d + f + g - i - j AS L FROM w3),
cel AS ({" UNION ALL ".join(f"SELECT x.entidade, x.ex, x.df, '{c}' AS coluna, (y.{c} - x.{c})::BIGINT AS diferenca FROM x JOIN y ON x.entidade = y.entidade AND x.ex = y.ex AND x.df = y.df" for c in CELLS)}),
kn AS (SELECT entidade, ex, df, coalesce(sum(pago_aproc) FILTER (anoempenho = ex - 1 AND proc > 0 AND aproc = 0), 0) AS c1, coalesce(sum(pago_proc) FILTER (anoempenho = ex - 1 AND aproc > 0 AND proc = 0), 0) AS i1,
 coalesce(sum(canc_v2_p - canc_v1_p) FILTER (ex >= {SPLIT_FROM}), 0) AS d2, coalesce(sum(canc_v2_n - CASE WHEN aproc > 0 THEN cancelado_aproc ELSE 0 END) FILTER (ex >= {SPLIT_FROM}), 0) AS j2 FROM rec GROUP BY ALL),
k0 AS (SELECT cel.*, ({_cause_sql(1)})::BIGINT AS m1, ({_cause_sql(2)})::BIGINT AS m2 FROM cel JOIN kn USING (entidade, ex, df)),
k1 AS (SELECT *, m1 <> 0 AND abs(diferenca - m1) < abs(diferenca) AS t1 FROM k0), k2 AS (SELECT *, diferenca - CASE WHEN t1 THEN m1 ELSE 0 END AS r1 FROM k1),
k3 AS (SELECT *, m2 <> 0 AND abs(r1 - m2) < abs(r1) AS t2 FROM k2), k4 AS (SELECT *, r1 - CASE WHEN t2 THEN m2 ELSE 0 END AS r2 FROM k3),
pr(x, y) AS (VALUES {", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in PAIRS)}),
sw AS (SELECT k4.*, EXISTS (SELECT 1 FROM pr JOIN cel o ON o.coluna = pr.y WHERE pr.x = k4.coluna AND o.entidade = k4.entidade AND o.ex = k4.ex AND o.df = k4.df AND k4.diferenca <> 0 AND o.diferenca = -k4.diferenca) AS trocada FROM k4),
cl AS (SELECT *, CASE WHEN diferenca = 0 THEN 'concorda' WHEN r2 = 0 THEN 'causa_comprovada' WHEN trocada THEN 'regra_de_classificacao' WHEN t1 OR t2 THEN 'causa_parcial' ELSE 'sem_causa' END AS classe FROM sw),
res AS (SELECT entidade, ex, df, coluna, diferenca, classe, CASE WHEN classe = 'concorda' THEN '' WHEN classe = 'regra_de_classificacao' THEN 'troca de soma zero: ' || diferenca
 ELSE concat_ws('; ', CASE WHEN t1 THEN '{PAID}: ' || m1 END, CASE WHEN t2 THEN '{SPLIT}: ' || m2 END) END AS causas, CASE WHEN classe = 'regra_de_classificacao' THEN 0 ELSE r2 END::BIGINT AS resto FROM cl)"""


@query(f"{RESIDUAL_SQL} SELECT * FROM res")
def difference_residuals(spark, sf_dir):
    """Every difference between two versions' cells: its class, the causes taken with their amounts, and the rest."""
    told = F.array_join(F.transform("tomadas", lambda t: F.concat(t["causa"], F.lit(": "), t["valor"].cast("string"))), "; ")
    return _classified(spark, sf_dir).select(*POINT, "coluna", "diferenca", "classe", told.alias("causas"), "resto")


@query(f"{RESIDUAL_SQL} SELECT ex, df, classe, count(*)::BIGINT AS celulas, sum(diferenca)::BIGINT AS diferenca, sum(diferenca - resto)::BIGINT AS explicado, sum(resto)::BIGINT AS resto FROM res GROUP BY ALL")
def difference_classes(spark, sf_dir):
    """The concordance by class: cells, what they differ by, what causes explain of it, and the rest."""
    return _classified(spark, sf_dir).groupBy("ex", "df", "classe").agg(F.count(F.lit(1)).alias("celulas"), F.sum("diferenca").alias("diferenca"), F.sum(F.col("diferenca") - F.col("resto")).alias("explicado"), F.sum("resto").alias("resto"))


#: The instants asked, as canonical texts; the last stands for the present.
WHEN = tuple(intervals.canonical_text(f"{i.replace(' ', 'T')}+00:00") for i in INSTANTS)


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the events as intervals of validity, a stored layer; a refused one never counts."""
    rows = lambda: intervals.intervals(snapshots(spark, sf_dir), ["user_id"], ["ts", "uid"], "ts", ~F.col("bad"), ["uid", "event_type", "valor"])
    return layer(spark, "vigencias", "1", [f"{sf_dir}/events.parquet"], lambda: rows().withColumn("mes", F.date_format("de", "yyyy-MM")), ["mes"], ["de"])


ASOF_SQL = f"""{SNAP_SQL}, i(vigencia, inst) AS (VALUES {", ".join(f"('{w}', TIMESTAMP '{i}')" for w, i in zip(WHEN, INSTANTS, strict=True))}),
v AS (SELECT vigencia, user_id, uid, event_type, valor FROM snap JOIN i ON ts <= inst WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY vigencia, user_id ORDER BY ts DESC, uid DESC) = 1)"""


@query(f"{ASOF_SQL} SELECT vigencia, event_type, count(*)::BIGINT AS cortes, sum(valor)::BIGINT AS valor, min(uid)::BIGINT AS primeiro, max(uid)::BIGINT AS ultimo FROM v GROUP BY ALL")
def derived_asof(spark, sf_dir):
    """The totals of the valid snapshots as they were at each instant, all from one stored table."""
    found = intervals.valid_at_each(validity(spark, sf_dir), list(WHEN))
    return found.groupBy("vigencia", "event_type").agg(F.count(F.lit(1)).alias("cortes"), F.sum("valor").alias("valor"), F.min("uid").alias("primeiro"), F.max("uid").alias("ultimo"))


@query(f"""{ASOF_SQL} SELECT a.vigencia, a.user_id, a.uid AS antes, b.uid AS depois, a.valor AS valor_antes, b.valor AS valor_depois, (b.valor - a.valor)::BIGINT AS diferenca FROM v a JOIN v b ON a.user_id = b.user_id AND b.vigencia = '{WHEN[-1]}'
WHERE a.vigencia <> b.vigencia AND a.uid <> b.uid""")
def divergence_by_validity(spark, sf_dir):
    """Cut-offs whose valid snapshot has changed between an earlier instant and the last."""
    return intervals.divergence(validity(spark, sf_dir), list(WHEN), ["user_id"], "uid", "valor")


#: What the batch says it touches, and faults elsewhere: a changed balance, a lost partition, one that appears.
TOUCHED, SIDE, GONE = "ex = 1997", "ex = 1999 AND df = '1999-08-31' AND empenho % 7 = 3", "ex = 1995 AND df = '1995-12-31'"
EXTRA_EX = 2050
KEPT = ["entidade", "anoempenho", "empenho", "s1", "s2", "s3"]


@query(f"""{RECORDS}, b AS (SELECT ex, df, {", ".join(KEPT)} FROM rec),
a AS (SELECT ex, df, entidade, anoempenho, empenho, s1 + CASE WHEN ({TOUCHED} AND df <> '1997-04-30') OR ({SIDE}) THEN 1 ELSE 0 END AS s1, s2, s3 FROM b WHERE NOT ({GONE}) UNION ALL SELECT {EXTRA_EX}, '{EXTRA_EX}-12-31', entidade, anoempenho, empenho, s1, s2, s3 FROM b WHERE {TOUCHED} AND df = '1997-12-31'),
p AS (SELECT ex, df FROM a UNION SELECT ex, df FROM b), n AS (SELECT ex, df, (SELECT count(*) FROM b WHERE b.ex = p.ex AND b.df = p.df) AS nb, (SELECT count(*) FROM a WHERE a.ex = p.ex AND a.df = p.df) AS na FROM p),
d AS (SELECT DISTINCT ex, df FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) u)
SELECT n.ex::BIGINT AS ex, n.df, nullif(nb, 0)::BIGINT AS linhas_antes, nullif(na, 0)::BIGINT AS linhas_depois, CASE WHEN na = 0 THEN 'sumida' WHEN nb = 0 AND NOT (n.{TOUCHED}) THEN 'alterada fora do lote' WHEN nb = 0 THEN 'nova' WHEN d.ex IS NULL THEN 'igual'
 WHEN n.{TOUCHED} THEN 'alterada pelo lote' ELSE 'alterada fora do lote' END AS situacao FROM n LEFT JOIN d ON n.ex = d.ex AND n.df = d.df""")
def refresh_proof(spark, sf_dir):
    """Partitions of the ledger before and after a batch of one year, by their hashes: those it may change, those that must be the same."""
    before = records(spark, sf_dir).select(*CUTOFF, *KEPT)
    off = F.expr(f"({TOUCHED} AND df <> '1997-04-30') OR ({SIDE})")
    after = before.where(f"NOT ({GONE})").withColumn("s1", F.col("s1") + F.when(off, 1).otherwise(0))
    appears = before.where(f"{TOUCHED} AND df = '1997-12-31'").withColumns({"ex": F.lit(EXTRA_EX).cast("long"), "df": F.lit(f"{EXTRA_EX}-12-31")})
    after = after.unionByName(appears)
    touched = before.where(TOUCHED).select(*CUTOFF).distinct()
    return refresh.proof(refresh.fingerprints(before, KEPT, CUTOFF), refresh.fingerprints(after, KEPT, CUTOFF), touched, CUTOFF)


#: Objects stored when the root was written; those lost and those changed since. Leaves and fan are small, so that the tree has levels.
LOST, ALTERED, WIDTH, FAN = "event_id % 1499 = 5", "event_id % 997 = 7", 64, 4
_OBJECT = ["event_type", "valor"]
TREE_SQL = f"""WITH o AS (SELECT event_id, event_type, round(value * 100)::BIGINT AS valor, (SELECT (max(event_id) * 4) // 5 FROM events) AS limite FROM events),
old AS (SELECT event_id, event_type, valor FROM o WHERE event_id <= limite), neu AS (SELECT event_id, event_type, valor + CASE WHEN {ALTERED} AND event_id <= limite THEN 1 ELSE 0 END AS valor FROM o WHERE NOT ({LOST} AND event_id <= limite))"""


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The objects when the root was written and now: a fifth has been added, some are lost, some changed."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", cents(F.col("value")).alias("valor"))
    limit = F.lit(rows.agg(F.expr("max(event_id) * 4 div 5")).first()[0])
    inside = F.col("event_id") <= limit
    now = rows.where(~(F.expr(LOST) & inside)).withColumn("valor", F.col("valor") + F.when(F.expr(ALTERED) & inside, 1).otherwise(0))
    return rows.where(inside), now


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new = _objects(spark, sf_dir)
    before = hashtree.tree(old, "event_id", _OBJECT, WIDTH, FAN)
    height = before.agg(F.max("nivel")).first()[0]
    return old, new, before, hashtree.tree(new, "event_id", _OBJECT, WIDTH, FAN, height)


@query(f"""{TREE_SQL} SELECT old.event_id, CASE WHEN neu.event_id IS NULL THEN 'perdido' ELSE 'alterado' END AS situacao FROM old LEFT JOIN neu ON old.event_id = neu.event_id
WHERE neu.event_id IS NULL OR old.valor IS DISTINCT FROM neu.valor OR old.event_type IS DISTINCT FROM neu.event_type""")
def root_manifest_losses(spark, sf_dir):
    """Objects of the root that are lost or changed, found from the root of the tree down; added ones are no fault."""
    old, new, before, after = _trees(spark, sf_dir)
    return hashtree.losses(old, new, hashtree.differing(before, after, FAN), "event_id", _OBJECT, WIDTH)


@query(f"""{TREE_SQL}, u AS ((SELECT * FROM old EXCEPT ALL SELECT * FROM neu) UNION ALL (SELECT * FROM neu EXCEPT ALL SELECT * FROM old)), l AS (SELECT event_id // {WIDTH} AS no, count(*) AS linhas FROM old GROUP BY ALL)
SELECT l.no::BIGINT AS no, l.linhas::BIGINT AS linhas FROM l WHERE EXISTS (SELECT 1 FROM u WHERE u.event_id // {WIDTH} = l.no)""")
def root_manifest_leaves(spark, sf_dir):
    """Leaves of the stored tree that aren't what they were: those of lost and changed objects, and the one that growth fills up."""
    _, _, before, after = _trees(spark, sf_dir)
    return hashtree.differing(before, after, FAN).where("nivel = 0").select("no", "linhas")


#: Links to orders that aren't there, and lines that break the declared rule, as planted in the second and third table.
DANGLING, BROKEN = "l_orderkey % 101 = 3", "l_linenumber = 5 AND l_orderkey % 64 < 2"
WRITE_SQL = f"""WITH l AS (SELECT l_orderkey AS pedido, l_linenumber AS linha, round(l_extendedprice * 100)::BIGINT AS valor, {DANGLING} AS solta, {BROKEN} AS ruim FROM lineitem),
n AS (SELECT count(*) AS n, count(*) FILTER (solta) AS soltas, count(*) FILTER (ruim AND valor > 0) AS ruins, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = pedido)) AS orfas, count(*) FILTER (valor < 0) AS negativas FROM l),
t AS (SELECT 'inteira' AS tabela, orfas AS a, negativas AS b, 0 AS c FROM n UNION ALL SELECT 'com ligação solta', soltas + (SELECT count(*) FROM l WHERE NOT solta AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = pedido)), negativas, 0 FROM n
 UNION ALL SELECT 'contra a regra', orfas, negativas + ruins, 0 FROM n UNION ALL SELECT 'sem linhas', (SELECT count(*) FROM l WHERE linha > 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = pedido)), (SELECT count(*) FROM l WHERE linha > 1 AND valor < 0), (SELECT count(*) FROM l WHERE linha = 1) FROM n)"""


@query(f"""{WRITE_SQL} SELECT tabela, regra, violacoes::BIGINT AS violacoes, a + b + c = 0 AS publicada FROM (SELECT *, a + b + c AS soma FROM t) UNPIVOT (violacoes FOR regra IN (a AS 'pedido inexistente', b AS 'valor negativo', c AS 'contagem'))""".replace("a + b + c = 0 AS publicada", "soma = 0 AS publicada"))
def staged_writes(spark, sf_dir):
    """Four tries to write the lines, whole and with a fault each: violations counted as they are written, and whether anything was published."""
    line = read(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("pedido"), F.col("l_linenumber").alias("linha"), cents(F.col("l_extendedprice")).alias("valor"), F.expr(DANGLING).alias("solta"), F.expr(BROKEN).alias("ruim"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    faults = {
        "inteira": rows,
        "com ligação solta": rows.withColumn("pedido", F.when(F.col("solta"), -F.col("pedido")).otherwise(F.col("pedido"))),
        "contra a regra": rows.withColumn("valor", F.when(F.col("ruim"), -F.col("valor")).otherwise(F.col("valor"))),
        "sem linhas": rows.where("linha > 1"),
    }
    expected, out = line.count(), []
    for name, made in faults.items():
        root = f"{shared_folder(spark)}/lancamentos-{uuid.uuid4().hex}"
        checked = staging.linked(made.select("pedido", "linha", "valor"), "pedido", orders, "o_orderkey", "__solta")
        table = staging.Table(checked, {"pedido inexistente": F.col("__solta"), "valor negativo": F.col("valor") < 0}, expected)
        try:
            seen = staging.write_all(spark, root, {"lancamento": table})
        except staging.Refused as e:
            seen = {("lancamento", r): 0 for r in (*table.rules, "contagem")} | e.violations
        there = staging.published(spark, root) is not None
        staging.remove(spark, root)
        out += [(name, rule, n, there) for (_, rule), n in seen.items()]
    return spark.createDataFrame(out, "tabela string, regra string, violacoes bigint, publicada boolean")
