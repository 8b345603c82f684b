"""The panel's whole answers: context and catalog as of an instant, items and reasons of a cut-off, indicators with them, all dimensions, the opening page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import creditor_type
from ..operators import answers as ans
from ..operators import indicators as ind
from ..operators import pairing as pair
from ..operators import series as ser
from ..operators import validity as val
from .audit import states
from .history import INSTANTS, SNAP_SQL, snapshots
from .indicators import ALL_SUMS, COPIES, ORIGINALS, copy_base, records
from .panel import GATE_SQL, LISTED_SQL, SUM_NAMES, _gate, listed
from .registry import RECORDS, query
from .relations import FIRST, MATCH

# ---------------------------------------------------------------- context and catalog

CONTEXT_SQL = f"""{SNAP_SQL}, dv AS (SELECT uid AS id, uid - uid % 50 AS normalizacao, CASE WHEN uid % 3 = 0 THEN em END AS vigencia_em FROM snap WHERE uid % 70 = 0),
rn AS (SELECT uid AS id, CASE WHEN uid % 100 <> 0 THEN uid END AS ultima FROM snap WHERE uid % 50 = 0),
lx AS (SELECT d.id AS derivacao, d.normalizacao, coalesce(rn.ultima, (SELECT max(uid) FROM snap WHERE NOT bad AND uid - uid % 50 = d.normalizacao), 0)::BIGINT AS limite FROM dv d JOIN rn ON rn.id = d.normalizacao WHERE vigencia_em IS NULL AND d.id = (SELECT max(id) FROM dv WHERE vigencia_em IS NULL))"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = snapshots(spark, sf_dir), F.col("uid") - F.col("uid") % 50
    derivations = s.where("uid % 70 = 0").select(F.col("uid").alias("id"), n.alias("normalizacao"), F.when(F.col("uid") % 3 == 0, F.col("em")).alias("vigencia_em"))
    runs = s.where("uid % 50 = 0").select(F.col("uid").alias("id"), F.when(F.col("uid") % 100 != 0, F.col("uid")).alias("ultima"))
    return ans.context(derivations, runs, s.where("not bad").select(n.alias("normalizacao"), F.col("uid").alias("coleta")))


@query(f"{CONTEXT_SQL} SELECT user_id, derivacao, normalizacao, limite, count(*) FILTER (uid <= limite)::BIGINT AS lidas, count(*) FILTER (uid > limite AND NOT bad)::BIGINT AS pendentes FROM snap, lx GROUP BY ALL")
def context(spark, sf_dir):
    """The derivation and run that answers rest on, and each entity's collections that the run had read and those, complete, that wait for the next."""
    both = snapshots(spark, sf_dir).crossJoin(F.broadcast(_context(spark, sf_dir)))  # one row
    beyond = F.col("uid") > F.col("limite")
    return both.groupBy("user_id", "derivacao", "normalizacao", "limite").agg(F.count_if(~beyond).alias("lidas"), F.count_if(beyond & ~F.col("bad")).alias("pendentes"))


YEAR = 1998
_TIMES = ", ".join(f"(TIMESTAMP '{i}')" for i in INSTANTS)


@query(f"""{CONTEXT_SQL}, i(em) AS (VALUES {_TIMES}), ok AS (SELECT snap.* FROM snap, lx WHERE NOT bad AND uid <= limite), us AS (SELECT DISTINCT user_id FROM snap),
ce AS (SELECT i.em, arg_max(uid, (ts, uid)) AS uid FROM ok JOIN i ON ok.ts <= i.em WHERE event_type = 'view' GROUP BY i.em),
en AS (SELECT user_id, em, 'E' || user_id::VARCHAR AS nome FROM us, ce WHERE (user_id + uid) % 5 <> 0),
cy AS (SELECT user_id, i.em, arg_max(uid, (ts, uid)) AS uid FROM ok JOIN i ON ok.ts <= i.em WHERE event_type = 'click' GROUP BY ALL),
yr AS (SELECT user_id, em, CASE WHEN uid % 11 = 0 THEN [] ELSE range(1996 + uid % 4, 2001 + uid % 3) END AS anos FROM cy),
se AS (SELECT user_id, i.em, array_to_string(list_sort(list(DISTINCT 1995 + uid % 6)), ',') AS vistos FROM ok JOIN i ON ok.ts <= i.em WHERE event_type = 'purchase' GROUP BY ALL),
k AS (SELECT user_id, em FROM en UNION SELECT user_id, em FROM yr UNION SELECT user_id, em FROM se)
SELECT k.user_id AS entidade, strftime(k.em, '%Y-%m-%d %H:%M:%S') AS em, nome, nome IS NOT NULL AS no_catalogo, anos[1]::BIGINT AS primeiro, anos[-1]::BIGINT AS ultimo, coalesce(array_to_string(anos, ','), '') AS oficiais, coalesce(vistos, '') AS vistos,
 CASE WHEN anos IS NULL OR len(anos) = 0 THEN 'sem catálogo de exercícios' WHEN list_contains(anos, {YEAR}) THEN 'no catálogo oficial' ELSE 'fora do catálogo oficial' END AS situacao
FROM k LEFT JOIN en ON en.user_id = k.user_id AND en.em = k.em LEFT JOIN yr ON yr.user_id = k.user_id AND yr.em = k.em LEFT JOIN se ON se.user_id = k.user_id AND se.em = k.em""")
def entities_asof(spark, sf_dir):
    """Entities as three instants knew them: by the catalog's newest snapshot, each entity's newest list of years, and the years seen, of what the run in use had read."""
    s = snapshots(spark, sf_dir)
    ok = s.where("not bad").join(F.broadcast(_context(spark, sf_dir).select("limite")), F.col("uid") <= F.col("limite"))  # one row
    instants = spark.createDataFrame([(i,) for i in INSTANTS], "em string").select(F.col("em").cast("timestamp").alias("em"))
    newest = lambda kind, by: val.as_of(ok.where(F.col("event_type") == kind), instants, by, "ts", ["ts", "uid"], ["uid"])
    whole = val.as_of(ok.where("event_type = 'view'").withColumn("__all", F.lit(0)), instants, ["__all"], "ts", ["ts", "uid"], ["uid"])
    users = s.select(F.col("user_id").alias("entidade")).distinct()
    names = users.crossJoin(F.broadcast(whole.select("em", "uid"))).where("(entidade + uid) % 5 <> 0")  # three rows
    u = F.col("uid")
    span = F.when(u % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(u % 4 + 1996, u % 3 + 2000))
    years = newest("click", ["user_id"]).select(F.col("user_id").alias("entidade"), "em", span.alias("exercicios"))
    seen = ans.seen_by(ok.where("event_type = 'purchase'").select(F.col("user_id").alias("entidade"), (u % 6 + 1995).alias("ex"), "ts"), instants, ["entidade"], "ex", "ts")
    found = ans.catalog(names.select("entidade", "em", F.concat(F.lit("E"), F.col("entidade").cast("string")).alias("nome")), years, seen, YEAR)
    return found.withColumn("em", F.date_format("em", "yyyy-MM-dd HH:mm:ss"))


# ---------------------------------------------------------------- the cut-off in words

_TEXTS = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ans.STATE_TEXTS.items()) + " END"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
APPROXIMATE, REFUSED = "(entidade + ex) % 5 = 0", "(entidade * 3 + ex) % 7 = 0"
ITEMS_SQL = f"""{GATE_SQL}, ct AS (SELECT entidade, ex, df, count(*) AS n FROM rec GROUP BY ALL), it AS (SELECT sp.*, CASE WHEN g.entidade IS NOT NULL THEN ct.n END AS n FROM sp JOIN ct ON sp.entidade = ct.entidade AND sp.ex = ct.ex AND sp.df = ct.df LEFT JOIN got g ON sp.entidade = g.entidade AND sp.ex = g.ex AND sp.df = g.df)"""
REASONS_SQL = f"""w1 AS (SELECT ex, df, estado, min(entidade) AS o, {_TEXTS.format(c="estado")} || ' para a(s) entidade(s) [' || string_agg(entidade::VARCHAR, ', ' ORDER BY entidade) || ']' AS t FROM sp GROUP BY ex, df, estado),
wy AS (SELECT ex, df, CASE WHEN count(*) FILTER (estado IN ({_IN(ans.MISSING)})) > 0 THEN string_agg(t, '; ' ORDER BY o) FILTER (estado IN ({_IN(ans.MISSING)})) WHEN count(*) FILTER (estado IN ({_IN(ans.SUMMED)})) = 0 THEN '{ans.NONE_SUMMED}' END AS motivo FROM w1 GROUP BY ex, df)"""


def _warned(found: DataFrame) -> DataFrame:
    return found.withColumn("__w", ans.warnings(F.col("situacao"), F.col("registros"), F.col("entidade"), F.col("ex"), F.expr(APPROXIMATE), F.expr(REFUSED)))


_WARNINGS_SQL = f"""list_filter([CASE WHEN n IS NOT NULL AND {APPROXIMATE} THEN 'entidade ' || entidade || ': horário de conclusão aproximado' END, CASE WHEN {REFUSED} THEN 'entidade ' || entidade || ': retrato mais novo recusado' END,
 CASE WHEN n > 0 AND estado = 'fora_do_escopo' THEN 'entidade ' || entidade || ' fora do catálogo do portal com registros no snapshot: não compõe o Município' END,
 CASE WHEN n > 0 AND estado = 'inexistente' THEN 'entidade ' || entidade || ' fora do catálogo oficial de ' || ex || ' com registros no snapshot: não somados ao Município' END], lambda x: x IS NOT NULL)"""


@query(f"{ITEMS_SQL} SELECT entidade, ex, df, estado AS situacao, {_TEXTS.format(c='estado')} AS texto, estado IN ({_IN(ans.SUMMED)}) AS entra_no_total, n::BIGINT AS registros, array_to_string({_WARNINGS_SQL}, '; ') AS avisos FROM it")
def cutoff_items(spark, sf_dir):
    """Every entity of every cut-off: its state in words, whether it is summed, its records, and what must be said of it."""
    found = _warned(_gate(spark, sf_dir)[0])
    s = F.col("situacao")
    return found.select("entidade", "ex", "df", "situacao", ans.state_text(s).alias("texto"), s.isin(*ans.SUMMED).alias("entra_no_total"), "registros", F.array_join("__w", "; ").alias("avisos"))


@query(f"{ITEMS_SQL}, {REASONS_SQL}, wa AS (SELECT ex, df, sum(len({_WARNINGS_SQL}))::BIGINT AS avisos FROM it GROUP BY ALL) SELECT wy.ex, wy.df, motivo IS NULL AS disponivel, motivo, avisos FROM wy JOIN wa ON wa.ex = wy.ex AND wa.df = wy.df")
def cutoff_reasons(spark, sf_dir):
    """Why a cut-off has no total, state by state with the entities, and how many warnings its entities carry."""
    found = _gate(spark, sf_dir)[0]
    counted = _warned(found).groupBy("ex", "df").agg(F.sum(F.size("__w")).cast("long").alias("avisos"))
    return ans.reasons(found).join(counted, ["ex", "df"]).select("ex", "df", F.col("motivo").isNull().alias("disponivel"), "motivo", "avisos")


_OWN_SQL = f"CASE WHEN situacao = 'inexistente' THEN '{ans.NOT_THERE}' WHEN situacao IN ({_IN(ans.MISSING)}) THEN {_TEXTS.format(c='situacao')} || ' para a(s) entidade(s) [' || entidade || ']' END"
_RESERVED_SQL = f"""half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), rv AS (SELECT DISTINCT b.ex, b.df FROM rec a, half, rec b WHERE a.entidade = {COPIES} AND a.empenho >= base_no AND b.entidade = {ORIGINALS} AND b.empenho = a.empenho - base_no AND a.ex = b.ex AND a.df = b.df AND a.anoempenho = b.anoempenho AND a.situacao IS NOT DISTINCT FROM b.situacao AND a.ex >= {FIRST}
 AND (b.situacao IS NULL OR abs(b.pago_proc) + abs(b.pago_aproc) + abs(b.cancelado_aproc) + abs(b.liquidado) > 0 OR a.proc <> b.proc OR a.aproc <> b.aproc))"""


@query(f"""{ITEMS_SQL}, {REASONS_SQL}, {_RESERVED_SQL}, pe AS (SELECT entidade, ex, df, {ALL_SUMS} FROM rec GROUP BY ALL), mu AS (SELECT pe.ex, pe.df, {", ".join(f"sum(pe.{n})::BIGINT AS {n}" for n in SUM_NAMES)} FROM pe JOIN sp ON sp.entidade = pe.entidade AND sp.ex = pe.ex AND sp.df = pe.df WHERE estado IN ({_IN(ans.SUMMED)}) GROUP BY ALL),
ow AS (SELECT *, {_OWN_SQL} AS motivo FROM st)
SELECT NULL::BIGINT AS entidade, wy.ex, wy.df, wy.motivo IS NULL AS disponivel, wy.motivo, wy.motivo IS NULL AND EXISTS (SELECT 1 FROM rv WHERE rv.ex = wy.ex AND rv.df = wy.df) AS com_ressalva, {", ".join(f"CASE WHEN wy.motivo IS NULL THEN mu.{n} END AS {n}" for n in SUM_NAMES)} FROM wy LEFT JOIN mu ON mu.ex = wy.ex AND mu.df = wy.df
UNION ALL SELECT ow.entidade, ow.ex, ow.df, ow.motivo IS NULL, ow.motivo, false, {", ".join(f"CASE WHEN ow.motivo IS NULL THEN pe.{n} END" for n in SUM_NAMES)} FROM ow LEFT JOIN pe ON pe.entidade = ow.entidade AND pe.ex = ow.ex AND pe.df = ow.df""")
def indicators_answer(spark, sf_dir):
    """The indicators of the Municipality (entity NULL) and of every entity: the values or, where none may be given, the reason; and whether pairs make the Municipality's uncertain. One sum of the ledger by entity serves both."""
    rec, own = records(spark, sf_dir), states(spark, sf_dir)
    found = _gate(spark, sf_dir)[0]
    per = ind.indicators(rec, ["entidade", "ex", "df"])
    summed = found.where(F.col("situacao").isin(*ans.SUMMED)).select("entidade", "ex", "df")
    city = per.join(summed, ["entidade", "ex", "df"], "left_semi").groupBy("ex", "df").agg(*[F.sum(n).cast("long").alias(n) for n in SUM_NAMES])
    doubt = pair.reservations(rec, COPIES, ORIGINALS, copy_base(spark, sf_dir), MATCH, FIRST).where("nao_consolidados > 0 or evidencia_incompleta > 0").select("ex", "df", F.lit(True).alias("duvida"))
    whole = ans.reasons(found).join(city, ["ex", "df"], "left").join(doubt, ["ex", "df"], "left").withColumn("entidade", F.lit(None).cast("long"))
    each = own.select("entidade", "ex", "df", ans.own_reason(F.col("situacao"), F.col("entidade")).alias("motivo")).join(per, ["entidade", "ex", "df"], "left").withColumn("duvida", F.lit(False))
    open_ = F.col("motivo").isNull()
    return whole.unionByName(each).select("entidade", "ex", "df", open_.alias("disponivel"), "motivo", (open_ & F.coalesce("duvida", F.lit(False))).alias("com_ressalva"), *[F.when(open_, F.col(n)).alias(n) for n in SUM_NAMES])


# ---------------------------------------------------------------- all dimensions, opening page

#: The closed list of dimensions.
DIMENSIONS = ["entidade", "anoempenho", "categoria", "fonte_recurso", "programatica", "orgao", "unidade", "funcao", "sub_funcao", "programa", "projeto", "elemento"]
OPEN_SQL = f"""{GATE_SQL}, {LISTED_SQL.removeprefix(RECORDS + ", ")}, q AS (SELECT l.*, CASE WHEN nacao % 7 <> 0 THEN lpad((empenho % 9)::VARCHAR, 3, '0') END AS unidade, lpad((empenho % 13)::VARCHAR, 3, '0') AS sub_funcao, left(programatica, 4) AS programa, right(programatica, 3) AS projeto, CASE WHEN segmento <> 'MACHINERY' THEN segmento END AS elemento
 FROM lst l JOIN sp ON sp.entidade = l.entidade AND sp.ex = l.ex AND sp.df = l.df JOIN av ON av.ex = l.ex AND av.df = l.df WHERE estado IN ({_IN(ans.SUMMED)}) AND motivo IS NULL)"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of summed entities at cut-offs whose total may be formed, with all budget codes."""
    found, gate = _gate(spark, sf_dir)
    may = found.where(F.col("situacao").isin(*ans.SUMMED)).join(gate.where("motivo is null").select("ex", "df"), ["ex", "df"], "left_semi").select("entidade", "ex", "df")
    e = F.col("empenho")
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    return listed(spark, sf_dir).join(may, ["entidade", "ex", "df"], "left_semi").withColumns({
        "unidade": F.when(F.col("nacao") % 7 != 0, pad(e % 9)), "sub_funcao": pad(e % 13), "programa": F.left("programatica", F.lit(4)), "projeto": F.right("programatica", F.lit(3)), "elemento": F.when(F.col("segmento") != "MACHINERY", F.col("segmento")),
    })


@query(f"{OPEN_SQL} {' UNION ALL '.join(f"SELECT ex, df, '{d}' AS dimensao, {d}::VARCHAR AS chave, count(*)::BIGINT AS registros, sum(proc + aproc)::BIGINT AS inscricao, sum(s1)::BIGINT AS s1 FROM q GROUP BY ex, df, {d}" for d in DIMENSIONS)}")
def all_dimensions(spark, sf_dir):
    """Totals by each of the twelve dimensions at every cut-off that has a total, from one pass."""
    return ans.by_dimensions(_open(spark, sf_dir), ["ex", "df"], DIMENSIONS)


TOPS = {"por_entidade": 8, "fonte_recurso": 6, "funcao": 8}
_BLOCKS = [("destino", "'pago'", 1, "pagos", "inscricao"), ("destino", "'cancelado'", 2, "cancelados", "inscricao"), ("destino", "'em_aberto'", 3, "s1", "inscricao"), ("situacao_do_saldo", "'a_liquidar'", 1, "s2", "s1"), ("situacao_do_saldo", "'liquidado_a_pagar'", 2, "s3", "s1"),
           ("por_entidade", "entidade", None, "s1", "s1"), ("categoria", "categoria", None, "s1", "s1"), ("tipo_credor", "tipo_credor", None, "s1", "s1"), ("fonte_recurso", "fonte_recurso", None, "s1", "s1"), ("funcao", "funcao", None, "s1", "s1")]
_TOP_SQL = "CASE bloco " + " ".join(f"WHEN '{b}' THEN {t}" for b, t in TOPS.items()) + " END"


@query(f"""{OPEN_SQL}, c AS (SELECT *, CASE WHEN regexp_full_match(coalesce(cnpj, ''), '\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}') THEN 'pessoa jurídica' WHEN cnpj LIKE '***%' THEN 'pessoa física' ELSE 'não identificado' END AS tipo_credor, pago_proc + pago_aproc AS pagos, cancelado_proc + cancelado_aproc AS cancelados, proc + aproc AS inscricao FROM q),
t AS (SELECT ex, df, sum(inscricao)::BIGINT AS inscricao, sum(s1)::BIGINT AS s1 FROM c GROUP BY ALL),
b AS ({" UNION ALL ".join(f"SELECT c.ex, c.df, '{b}' AS bloco, {k}::VARCHAR AS chave, {'NULL' if o is None else o}::INT AS ordem, sum(c.{v})::BIGINT AS valor, t.{total} AS total FROM c JOIN t ON t.ex = c.ex AND t.df = c.df GROUP BY c.ex, c.df, t.{total}, {k}::VARCHAR" for b, k, o, v, total in _BLOCKS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY ex, df, bloco ORDER BY ordem NULLS LAST, valor DESC, chave) AS k, count(*) OVER (PARTITION BY ex, df, bloco) AS n, {_TOP_SQL} AS tp FROM b),
p AS (SELECT ex, df, bloco, total, CASE WHEN n > tp + 1 AND k > tp THEN 'demais (' || (n - tp) || ' grupos)' ELSE chave END AS chave, sum(valor)::BIGINT AS valor, min(k)::BIGINT AS posicao FROM r GROUP BY ALL),
w AS (SELECT *, sum(valor) OVER (PARTITION BY ex, df, bloco) - total AS fora, min(valor) OVER (PARTITION BY ex, df, bloco) AS menor FROM p),
m AS (SELECT *, CASE WHEN fora <> 0 THEN 'as partes não somam o total (diferença de ' || fora || ' centavos): o gráfico não é desenhado' WHEN total = 0 THEN 'total zero: não há o que dividir' WHEN menor < 0 THEN 'há parte negativa, que um gráfico de pizza não representa: veja as colunas' END AS motivo FROM w),
f AS (SELECT *, CASE WHEN motivo IS NULL THEN valor * 1000 // total END AS fl, CASE WHEN motivo IS NULL THEN valor * 1000 % total END AS re FROM m)
SELECT ex, df, bloco, chave, valor, total, posicao, motivo, (fl + CASE WHEN row_number() OVER (PARTITION BY ex, df, bloco ORDER BY re DESC, posicao) <= 1000 - sum(fl) OVER (PARTITION BY ex, df, bloco) THEN 1 ELSE 0 END)::BIGINT AS decimos FROM f""")
def overview_blocks(spark, sf_dir):
    """The opening page's seven partitions at every cut-off that has a total: what became of the inscription, the state of the balance, and the balance by entity, category, kind of creditor, source and function. The ledger is summed once, by their combination."""
    finest = ["entidade", "categoria", "tipo_credor", "fonte_recurso", "funcao"]
    rows = _open(spark, sf_dir).withColumn("tipo_credor", creditor_type(F.col("cnpj")))
    sums = {"pagos": "pago_proc + pago_aproc", "cancelados": "cancelado_proc + cancelado_aproc", "inscricao": "proc + aproc", "s1": "s1", "s2": "s2", "s3": "s3"}
    small = rows.groupBy("ex", "df", *finest).agg(*[F.expr(f"sum({e})").cast("long").alias(n) for n, e in sums.items()])
    one = lambda b, k, o, v, total: F.struct(F.lit(b).alias("bloco"), F.expr(k).cast("string").alias("chave"), F.lit(o).cast("int").alias("ordem"), F.col(v).alias("valor"), F.lit(total).alias("de"))
    parts = small.select("ex", "df", F.explode(F.array(*[one(*b) for b in _BLOCKS])).alias("x")).groupBy("ex", "df", "x.bloco", "x.chave", "x.ordem", "x.de").agg(F.sum("x.valor").cast("long").alias("valor"))
    totals = small.groupBy("ex", "df").agg(F.sum("inscricao").cast("long").alias("inscricao"), F.sum("s1").cast("long").alias("s1"))
    full = parts.join(totals, ["ex", "df"]).withColumn("total", F.when(F.col("de") == "inscricao", F.col("inscricao")).otherwise(F.col("s1")))
    return ans.partition(full, ["ex", "df"], TOPS)


# ---------------------------------------------------------------- continuity by the latest opening

@query(f"""{RECORDS}, c AS (SELECT * FROM rec WHERE df LIKE '%-12-31'), lo AS (SELECT entidade, ex, max(df) AS df FROM rec GROUP BY ALL), o AS (SELECT r.* FROM rec r JOIN lo ON lo.entidade = r.entidade AND lo.ex = r.ex AND lo.df = r.df),
j AS (SELECT c.entidade, c.ex, lo.df AS abertura, c.s1, CASE WHEN o.empenho IS NULL AND c.s1 <> 0 THEN 'SALDO-SEM-CONTINUIDADE' WHEN o.empenho IS NULL THEN 'encerrado' WHEN o.proc = c.s3 AND o.aproc = c.s2 THEN 'continuo' ELSE 'DESCONTINUIDADE' END AS classe
 FROM c JOIN lo ON lo.entidade = c.entidade AND lo.ex = c.ex + 1 LEFT JOIN o ON o.entidade = c.entidade AND o.anoempenho = c.anoempenho AND o.empenho = c.empenho AND o.ex = c.ex + 1)
SELECT entidade, ex, abertura, classe, count(*)::BIGINT AS registros, sum(s1)::BIGINT AS s1 FROM j GROUP BY ALL""")
def continuity_latest(spark, sf_dir):
    """Every entity's closing of a year against its opening of the next, taken from the latest cut-off it has there; a year without one isn't compared."""
    rec = records(spark, sf_dir)
    last = rec.groupBy("entidade", "ex").agg(F.max("df").alias("df"))  # a row for each entity and year
    opening = rec.join(last, ["entidade", "ex", "df"], "left_semi").withColumn("ex", F.col("ex") - 1)
    compared = last.select("entidade", (F.col("ex") - 1).alias("ex"), F.col("df").alias("abertura"))
    closing = rec.where(F.col("df").endswith("-12-31")).join(compared, ["entidade", "ex"], "left_semi")
    found = ser.continuity(closing, opening, ["entidade", "anoempenho", "empenho", "ex"])
    counted = found.groupBy("entidade", "ex", "classe").agg(F.count(F.lit(1)).alias("registros"), F.sum("s1").cast("long").alias("s1"))
    return counted.join(compared, ["entidade", "ex"])
