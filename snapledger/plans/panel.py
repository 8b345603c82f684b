"""Lists and detail, gated indicators, scopes, catalogs, movements by code, checks and overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import cents, half_up_tenths, largest_remainder
from ..functions.text import FUNCTIONS, function_name
from ..operators import cutoffs, listing
from ..operators import indicators as ind
from ..operators import pairing as pair
from ..operators import reconcile as rec_ops
from ..operators.rules import MOVEMENT_CODES, interpret
from ..sources.ledger import read
from ..sources.store import cut
from .audit import STATES_SQL, states
from .history import SNAP_SQL, snapshots
from .indicators import ALL_SUMS, COPIES, ORIGINALS, STATEMENT_SQL, copy_base, records, statement
from .registry import RECORDS, query
from .relations import MATCH, PAIRS_SQL, _pairs, version_differences

SUM_NAMES = ("registros", *ind.SUMS)
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

# ---------------------------------------------------------------- lists

LISTED_SQL = f"""{RECORDS}, lst AS (SELECT *, CASE WHEN nacao % 5 <> 0 THEN lpad(nacao::VARCHAR, 2, '0') END AS orgao, lpad((nacao % 28 + 1)::VARCHAR, 2, '0') AS funcao, lpad((empenho % 97)::VARCHAR, 4, '0') || lpad((empenho % 31)::VARCHAR, 3, '0') AS programatica, nacao AS fonte_recurso,
 CASE empenho % 3 WHEN 0 THEN regexp_replace(lpad(empenho::VARCHAR, 14, '0'), '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5') WHEN 1 THEN '***' || lpad((empenho % 1000)::VARCHAR, 3, '0') || '***' END AS cnpj,
 CASE empenho % 4 WHEN 0 THEN '12.345.678/0001-90 - ' || segmento WHEN 1 THEN segmento || ' 123456789 x*123' WHEN 2 THEN ' ' END AS credor FROM rec)"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with budget codes, and creditors whose documents and names take all forms."""
    n, e = F.col("nacao"), F.col("empenho")
    pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
    company = listing.full_document(pad(e, 14))
    return records(spark, sf_dir).withColumns({
        "orgao": F.when(n % 5 != 0, pad(n, 2)), "funcao": pad(n % 28 + 1, 2), "programatica": F.concat(pad(e % 97, 4), pad(e % 31, 3)), "fonte_recurso": n,
        "cnpj": F.when(e % 3 == 0, company).when(e % 3 == 1, F.concat(F.lit("***"), pad(e % 1000, 3), F.lit("***"))),
        "credor": F.when(e % 4 == 0, F.concat(F.lit("12.345.678/0001-90 - "), "segmento")).when(e % 4 == 1, F.concat("segmento", F.lit(" 123456789 x*123"))).when(e % 4 == 2, " "),
    })


AT = "ex = 1999 AND df = '1999-12-31'"
SHOWN = ["entidade", "anoempenho", "empenho", "categoria", "s1"]


@query(f"{LISTED_SQL} SELECT {', '.join(SHOWN)}, funcao FROM lst WHERE {AT} AND categoria = 'ambos' AND faixa_n = 'f' AND starts_with(programatica, '00') AND funcao = '08' ORDER BY s1 DESC, entidade, anoempenho, empenho LIMIT 500")
def list_filtered(spark, sf_dir):
    """Several filters at once; a limit above the most is the most."""
    condition, _ = listing.filters(categoria="ambos", faixa="f", programatica="00", funcao="08")
    return listing.page(listed(spark, sf_dir).where(AT).where(condition), "saldo", 9999).select(*SHOWN, "funcao")


@query(f"{LISTED_SQL} SELECT {', '.join(SHOWN)} FROM lst WHERE {AT} AND orgao IS NULL ORDER BY entidade, anoempenho, empenho LIMIT 1 OFFSET 7")
def list_by_key_null(spark, sf_dir):
    """Records without a code, by key; a limit below one is one."""
    condition, _ = listing.filters(sem_classificacao="orgao")
    return listing.page(listed(spark, sf_dir).where(AT).where(condition), "chave", 0, 7).select(*SHOWN)


@query(f"{LISTED_SQL}, one AS (SELECT max(cnpj) AS c FROM lst WHERE {AT}) SELECT tipo, count(*)::BIGINT AS registros FROM (SELECT 'pessoa física' AS tipo FROM lst WHERE {AT} AND cnpj LIKE '***%' UNION ALL SELECT 'cnpj' FROM lst WHERE {AT} AND cnpj = '00.000.000/0000-03' UNION ALL SELECT 'numero' FROM lst WHERE {AT} AND anoempenho = 1997 AND fonte_recurso = 3) GROUP BY tipo")
def list_by_creditor(spark, sf_dir):
    """Filters by the creditor's kind, by a company's whole number, and by year and source."""
    rows = listed(spark, sf_dir).where(AT)
    chosen = {"pessoa física": dict(tipo_credor="pessoa física"), "cnpj": dict(cnpj="00000000000003"), "numero": dict(anoempenho=1997, fonte_recurso=3)}
    out = None
    for name, f in chosen.items():
        one = rows.where(listing.filters(**f)[0]).select(F.lit(name).alias("tipo"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tipo").agg(F.count(F.lit(1)).alias("registros"))


@query(f"""{LISTED_SQL}, x AS (SELECT DISTINCT empenho, cnpj, credor FROM lst WHERE {AT}), y AS (SELECT *, CASE WHEN regexp_full_match(coalesce(cnpj, ''), '\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}') THEN 'pessoa jurídica' WHEN cnpj LIKE '***%' THEN 'pessoa física' ELSE 'não identificado' END AS tipo_credor FROM x)
SELECT empenho, tipo_credor, CASE WHEN tipo_credor = 'pessoa física' THEN '[nome de pessoa física omitido]' WHEN starts_with(credor, '12.') THEN substr(credor, 22) WHEN trim(credor) <> '' THEN replace(replace(credor, '123456789', '[documento omitido]'), '*123', '[documento omitido]') END AS credor_publico FROM y""")
def list_public(spark, sf_dir):
    """Creditors as the public sees them."""
    return listing.at_level(listed(spark, sf_dir).where(AT).select("empenho", "cnpj", "credor").distinct(), "publico")


@query(f"""{LISTED_SQL}, a AS (SELECT empenho, ex, credor, cnpj, s1 FROM lst WHERE entidade = 2 AND df = '1998-12-31'), b AS (SELECT empenho, ex, credor, cnpj, s1 FROM lst WHERE entidade = 2 AND df = '1999-12-31')
SELECT a.empenho, f.campo, CASE WHEN f.campo = 's1' THEN a.s1::VARCHAR ELSE '[restrito]' END AS antes, CASE WHEN f.campo = 's1' THEN b.s1::VARCHAR ELSE '[restrito]' END AS depois FROM a JOIN b ON a.empenho = b.empenho, (VALUES ('s1'), ('credor')) f(campo)""")
def diff_redacted(spark, sf_dir):
    """Two snapshots side by side, restricted fields hidden."""
    rows = listed(spark, sf_dir).where("entidade = 2")
    side = lambda df, n: rows.where(F.col("df") == df).select("empenho", F.array(F.struct(F.lit("s1").alias("campo"), F.col("s1").cast("string").alias(n)), F.struct(F.lit("credor").alias("campo"), F.col("credor").alias(n))).alias(f"__{n}"))
    joined = side("1998-12-31", "antes").join(side("1999-12-31", "depois"), "empenho").select("empenho", F.explode(F.arrays_zip("__antes", "__depois")).alias("x"))
    return listing.redacted(joined.select("empenho", "x.__antes.campo", "x.__antes.antes", "x.__depois.depois"))


@query(f"""{PAIRS_SQL}, d AS (SELECT * FROM rec WHERE {AT}), p AS (SELECT * FROM pr WHERE {AT})
SELECT d.entidade, d.anoempenho, d.empenho, d.categoria, d.s1, d.s2, d.s3, CASE WHEN d.entidade = {COPIES} THEN a.b_empenho WHEN d.entidade = {ORIGINALS} THEN b.a_empenho END AS outro, CASE WHEN d.entidade = {COPIES} THEN a.relacao WHEN d.entidade = {ORIGINALS} THEN b.relacao END AS relacao,
 CASE WHEN d.entidade = {COPIES} AND a.b_empenho IS NOT NULL THEN 'A' WHEN d.entidade = {ORIGINALS} AND b.a_empenho IS NOT NULL THEN 'B' END AS posicao
FROM d LEFT JOIN p a ON d.entidade = {COPIES} AND a.anoempenho = d.anoempenho AND a.a_empenho = d.empenho LEFT JOIN p b ON d.entidade = {ORIGINALS} AND b.anoempenho = d.anoempenho AND b.b_empenho = d.empenho""")
def commitment_detail(spark, sf_dir):
    """Every commitment of a cut-off with its other side of a pair, if any, and which side it is."""
    p = _pairs(spark, sf_dir).where(AT)
    sides = p.select(F.lit(COPIES).cast("long").alias("entidade"), "anoempenho", F.col("a_empenho").alias("empenho"), F.col("b_empenho").alias("outro"), "relacao", F.lit("A").alias("posicao"))
    sides = sides.unionByName(p.select(F.lit(ORIGINALS).cast("long").alias("entidade"), "anoempenho", F.col("b_empenho").alias("empenho"), F.col("a_empenho").alias("outro"), "relacao", F.lit("B").alias("posicao")))
    return records(spark, sf_dir).where(AT).select("entidade", "anoempenho", "empenho", "categoria", "s1", "s2", "s3").join(sides, ["entidade", "anoempenho", "empenho"], "left")


# ---------------------------------------------------------------- gate

GATE_SQL = f"""{STATES_SQL}, sp AS (SELECT *, CASE WHEN entidade = 3 AND ex = 2001 THEN 'fora_do_escopo' ELSE situacao END AS estado FROM st),
g AS (SELECT ex, df, count(*) FILTER (estado IN ('com_dados', 'sem_rp'))::BIGINT AS somadas, coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade) FILTER (estado IN ('nao_processado', 'ambiguo', 'valor_recusado', 'incompleto', 'sem_coleta')), '') AS faltam,
 coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade) FILTER (estado = 'inexistente'), '') AS fora, coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade) FILTER (estado = 'fora_do_escopo'), '') AS fora_do_escopo FROM sp GROUP BY ALL),
av AS (SELECT *, CASE WHEN faltam <> '' THEN 'faltam entidades: ' || faltam WHEN somadas = 0 THEN 'nenhuma entidade com snapshot' END AS motivo FROM g)"""


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = states(spark, sf_dir)
    outside = F.when((F.col("entidade") == 3) & (F.col("ex") == 2001), "fora_do_escopo").otherwise(F.col("situacao"))
    found = found.withColumn("situacao", outside)
    return found, cutoffs.gate(found)


@query(f"{GATE_SQL} SELECT ex, df, somadas, faltam, fora, fora_do_escopo, motivo IS NULL AS disponivel, motivo, CASE WHEN df >= '2001-01-01' THEN 'corte posterior à coleta' END AS aviso, 'exercício ' || ex || ' até ' || strftime(df::DATE, '%d/%m/%Y') AS rotulo FROM av")
def cutoff_gate(spark, sf_dir):
    """Whether a cut-off's total may be formed, which entities are missing, outside the catalog or outside the scope, its label and warning."""
    day = F.to_date("df")
    label = F.concat(F.lit("exercício "), F.col("ex").cast("string"), F.lit(" até "), F.date_format(day, "dd/MM/yyyy"))
    late = F.when(day >= F.lit("2001-01-01").cast("date"), "corte posterior à coleta")
    return _gate(spark, sf_dir)[1].select("ex", "df", "somadas", "faltam", "fora", "fora_do_escopo", F.col("motivo").isNull().alias("disponivel"), "motivo", late.alias("aviso"), label.alias("rotulo"))


@query(f"""{GATE_SQL}, s AS (SELECT r.ex, r.df, {ALL_SUMS} FROM rec r JOIN sp ON sp.entidade = r.entidade AND sp.ex = r.ex AND sp.df = r.df WHERE estado IN ('com_dados', 'sem_rp') GROUP BY ALL)
SELECT av.ex, av.df, av.motivo, {", ".join(f"CASE WHEN av.motivo IS NULL THEN s.{n} END AS {n}" for n in SUM_NAMES)} FROM av LEFT JOIN s ON s.ex = av.ex AND s.df = av.df""")
def ind_gated(spark, sf_dir):
    """The indicators of the Municipality where its total may be formed, else no value and the reason."""
    found, gate = _gate(spark, sf_dir)
    summed = found.where(F.col("situacao").isin("com_dados", "sem_rp")).select("entidade", "ex", "df")
    sums = ind.indicators(records(spark, sf_dir).join(summed, ["entidade", "ex", "df"], "left_semi"), ["ex", "df"])
    open_ = F.col("motivo").isNull()
    return gate.select("ex", "df", "motivo").join(sums, ["ex", "df"], "left").select("ex", "df", "motivo", *[F.when(open_, F.col(n)).alias(n) for n in SUM_NAMES])


#: Years, text and certainty (2: explained, 1: hypothesis) of known differences between the balance and the orders' own totals; years without a statement.
BALANCE_CATALOG = [([1993, 1994, 1996, 1997], "descontos e impostos das linhas", 2), ([1996, 1999], "linhas canceladas", 1)]
NO_STATEMENT = 3


@query(f"""{GATE_SQL}, s AS (SELECT ex, df, sum(s1)::BIGINT AS s1 FROM rec GROUP BY ALL), o AS (SELECT ex, df, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS declarado FROM rec JOIN orders ON o_orderkey = empenho WHERE s1 > 0 AND ex % {NO_STATEMENT} <> 0 GROUP BY ALL),
k(anos, texto, certeza) AS (VALUES {", ".join(f"({a}, '{t}', {n})" for a, t, n in BALANCE_CATALOG)}),
d AS (SELECT av.ex, av.df, av.motivo, CASE WHEN av.motivo IS NULL THEN s.s1 END AS s1, o.declarado, CASE WHEN av.motivo IS NULL THEN (s.s1 - o.declarado)::BIGINT END AS diferenca FROM av JOIN s ON s.ex = av.ex AND s.df = av.df LEFT JOIN o ON o.ex = av.ex AND o.df = av.df),
e AS (SELECT d.ex, d.df, d.motivo, d.s1, d.declarado, d.diferenca, coalesce(string_agg(texto, '; ' ORDER BY texto), '') AS explicacao, max(certeza) AS certeza FROM d LEFT JOIN k ON list_contains(k.anos, d.ex) AND d.diferenca <> 0 GROUP BY ALL)
SELECT ex, df, s1, declarado, diferenca, explicacao, CASE WHEN motivo IS NOT NULL THEN 'sem valor' WHEN declarado IS NULL THEN 'sem demonstrativo' WHEN diferenca = 0 THEN 'sem diferença' WHEN certeza = 2 THEN 'explicada' WHEN certeza = 1 THEN 'hipótese' ELSE 'não determinada' END AS situacao FROM e""")
def balance_check(spark, sf_dir):
    """The balance beside what the orders' own totals declare of the commitments that are still open, and what the catalog explains of the difference; nothing is replaced."""
    gate = _gate(spark, sf_dir)[1].select("ex", "df", F.col("motivo").isNull().alias("open"))
    rec = records(spark, sf_dir)
    s = rec.groupBy("ex", "df").agg(F.sum("s1").cast("long").alias("s1"))
    totals = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("empenho"), cents(F.col("o_totalprice")).alias("t"))
    declared = rec.where(f"s1 > 0 AND ex % {NO_STATEMENT} <> 0").select("ex", "df", "empenho").join(totals, "empenho").groupBy("ex", "df").agg(F.sum("t").cast("long").alias("declarado"))
    both = gate.join(s, ["ex", "df"]).join(declared, ["ex", "df"], "left").withColumn("s1", F.when(F.col("open"), F.col("s1")))
    catalog = spark.createDataFrame(BALANCE_CATALOG, "anos array<bigint>, texto string, certeza int")
    found = rec_ops.explain(both.withColumn("diferenca", F.col("s1") - F.col("declarado")), catalog, [])
    kind = F.when(~F.col("open"), "sem valor").when(F.col("declarado").isNull(), "sem demonstrativo").otherwise(F.col("situacao"))
    return found.select("ex", "df", "s1", "declarado", "diferenca", "explicacao", kind.alias("situacao"))


#: Treatment of the extra entity in a bimester, and what it rests on; other bimesters have the default.
PERIODS = [("1997-2", "inclui", "comprovado"), ("1998-4", "exclui", "contraditorio"), ("1999-6", "inclui", "provavel"), ("2000-2", "exclui", "comprovado")]
DEFAULT_PERIOD = ("exclui", "inconclusivo")
#: What a total with a reservation is said to rest on.
RESERVATIONS = {"contraditorio": "demonstrativos divergentes", "provavel": "indício sem prova", "inconclusivo": "sem demonstrativo do período"}
EXTRA, UNTIL = 4, 1998


@query(f"""{RECORDS}, e AS (SELECT ex, df, coalesce(sum(s1) FILTER (entidade <> {EXTRA}), 0)::BIGINT AS sem, coalesce(sum(s1) FILTER (entidade = {EXTRA}), 0)::BIGINT AS extra FROM rec GROUP BY ALL),
p(periodo, tratamento, situacao) AS (VALUES {_VALUES(PERIODS)}), r(situacao, texto) AS (VALUES {_VALUES(RESERVATIONS.items())}),
x AS (SELECT e.*, coalesce(p.tratamento, '{DEFAULT_PERIOD[0]}') AS tratamento, coalesce(p.situacao, '{DEFAULT_PERIOD[1]}') AS situacao FROM e LEFT JOIN p ON p.periodo = e.ex::VARCHAR || '-' || ((month(e.df::DATE) + 1) // 2)::VARCHAR)
SELECT ex, df, (sem + CASE WHEN ex <= {UNTIL} THEN extra ELSE 0 END)::BIGINT AS municipio_v1, tratamento, x.situacao, (sem + CASE WHEN tratamento = 'inclui' THEN extra ELSE 0 END)::BIGINT AS municipio_v2, r.texto AS ressalva FROM x LEFT JOIN r ON r.situacao = x.situacao""")
def scope_municipal(spark, sf_dir):
    """The Municipality with the extra entity by year (v1) and by bimester (v2), with the reservation that v2 carries."""
    part = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col("s1"))), F.lit(0)).cast("long").alias(n)
    e = records(spark, sf_dir).groupBy("ex", "df").agg(part(F.col("entidade") != EXTRA, "sem"), part(F.col("entidade") == EXTRA, "extra"))
    treatment, situation, note = cutoffs.extra_entity(F.col("ex"), F.to_date("df"), PERIODS, DEFAULT_PERIOD, RESERVATIONS)
    x = e.withColumns({"tratamento": treatment, "situacao": situation, "ressalva": note})
    with_extra = lambda cond: (F.col("sem") + F.when(cond, F.col("extra")).otherwise(0)).cast("long")
    return x.select("ex", "df", with_extra(F.col("ex") <= UNTIL).alias("municipio_v1"), "tratamento", "situacao", with_extra(F.col("tratamento") == "inclui").alias("municipio_v2"), "ressalva")


@query(f"""{PAIRS_SQL}, x AS (SELECT b.ex, b.df, b.proc + b.aproc AS insc, (abs(b.pago_proc) + abs(b.pago_aproc) + abs(b.cancelado_aproc) + abs(b.liquidado)) > 0 OR a.proc <> b.proc OR a.aproc <> b.aproc AS executado, b.situacao IS NULL AS nulo
 FROM rec a, half, rec b WHERE a.entidade = {COPIES} AND a.empenho >= base_no AND b.entidade = {ORIGINALS} AND b.empenho = a.empenho - base_no AND a.ex = b.ex AND a.df = b.df AND a.anoempenho = b.anoempenho AND a.situacao IS NOT DISTINCT FROM b.situacao)
SELECT ex, df, count(*) FILTER (executado)::BIGINT AS nao_consolidados, coalesce(sum(insc) FILTER (executado), 0)::BIGINT AS inscricao_original, count(*) FILTER (NOT executado AND nulo)::BIGINT AS evidencia_incompleta FROM x GROUP BY ALL""")
def pairs_reserved(spark, sf_dir):
    """Pairs that make a total uncertain: both sides summed, or matched on NULL fields alone. All years are told; which of them count against a total is ``indicators_answer``'s matter."""
    return pair.reservations(records(spark, sf_dir), COPIES, ORIGINALS, copy_base(spark, sf_dir), MATCH)


# ---------------------------------------------------------------- catalogs

@query(f"""{RECORDS}, o AS (SELECT entidade, list_sort(list(DISTINCT ex)) AS obs FROM rec GROUP BY entidade), c AS (SELECT r_regionkey::BIGINT AS entidade, r_name AS nome, CASE WHEN r_regionkey <> 2 THEN list_transform(range(1996 + r_regionkey, 2002), lambda y: y::BIGINT) END AS ofic FROM region)
SELECT c.entidade, nome, ofic[1] AS primeiro, ofic[-1] AS ultimo, array_to_string(obs, ',') AS observados, CASE WHEN ofic IS NULL THEN 'sem catálogo de exercícios' WHEN list_contains(ofic, 1998) THEN 'no catálogo oficial' ELSE 'fora do catálogo oficial' END AS situacao FROM c LEFT JOIN o ON o.entidade = c.entidade""")
def entities_catalog(spark, sf_dir):
    """Each entity with its official and observed fiscal years, and its situation in 1998."""
    k = F.col("r_regionkey").cast("long")
    official = read(spark, sf_dir, "region").select(k.alias("entidade"), F.col("r_name").alias("nome"), F.when(k != 2, F.sequence(k + 1996, F.lit(2001).cast("long"))).alias("ofic"))
    seen = records(spark, sf_dir).groupBy("entidade").agg(F.array_join(F.array_sort(F.collect_set("ex")).cast("array<string>"), ",").alias("observados"))
    return cutoffs.in_catalog(official, 1998).join(seen, "entidade", "left").select("entidade", "nome", "primeiro", "ultimo", "observados", "situacao")


@query(f"SELECT f.codigo, f.nome, count(n_nationkey)::BIGINT AS nacoes FROM (SELECT unnest(range(0, 31))::VARCHAR AS codigo) k LEFT JOIN nation ON (n_nationkey + 1)::VARCHAR = k.codigo JOIN (SELECT i::VARCHAR AS codigo, t.nome FROM (SELECT unnest(range(0, 31)) AS i) LEFT JOIN (VALUES {_VALUES((i, n) for i, n in enumerate(FUNCTIONS, 1))}) t(c, nome) ON t.c = i) f ON f.codigo = k.codigo GROUP BY ALL")
def function_names(spark, sf_dir):
    """Names of budget functions by code, padded or not; NULL for others."""
    codes = spark.range(31).select(F.col("id").cast("string").alias("codigo"))
    nations = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("string").alias("codigo"), "n_nationkey")
    return codes.join(nations, "codigo", "left").groupBy("codigo", function_name(F.col("codigo")).alias("nome")).agg(F.count("n_nationkey").alias("nacoes"))


# ---------------------------------------------------------------- movements

CODE_SQL = "[20, 21, 22, 30, 31, 33, 40, 41, 50, 51, 99][uid % 11 + 1]"
_CODES = lambda v: " ".join(f"WHEN {c} THEN '{e}'" for c, (e, s) in MOVEMENT_CODES.items() if v == 2 or c != 33)
_SIGNS = lambda v: " ".join(f"WHEN {c} THEN {s}" for c, (e, s) in MOVEMENT_CODES.items() if v == 2 or c != 33)


@query(f"""{SNAP_SQL}, m AS (SELECT uid, user_id, valor, {CODE_SQL} AS tipo FROM snap), v AS ({" UNION ALL ".join(f"SELECT 'v{v}' AS versao, *, coalesce(CASE tipo {_CODES(v)} END, 'desconhecido') AS efeito, coalesce(CASE tipo {_SIGNS(v)} END, 0) AS sinal, CASE WHEN tipo IN (40, 41) THEN user_id WHEN tipo IN (30, 31{', 33' if v == 2 else ''}, 50, 51) THEN uid END AS referencia FROM m" for v in (1, 2))})
SELECT versao, tipo::BIGINT AS tipo, efeito, sinal::BIGINT AS sinal, count(*)::BIGINT AS lancamentos, count(referencia)::BIGINT AS com_referencia, sum(valor * sinal)::BIGINT AS valor FROM v GROUP BY ALL""")
def movement_codes(spark, sf_dir):
    """Movements by type code under both versions: effect, sign, and whether they refer to a payment or to a liquidation."""
    codes = F.array(*[F.lit(c) for c in (20, 21, 22, 30, 31, 33, 40, 41, 50, 51, 99)])
    rows = snapshots(spark, sf_dir).withColumn("tipo", F.element_at(codes, (F.col("uid") % 11 + 1).cast("int")).cast("long"))
    out = None
    for version in ("v1", "v2"):
        effect, sign, reference = interpret(F.col("tipo"), F.col("uid"), F.col("user_id"), version)
        one = rows.select(F.lit(version).alias("versao"), "tipo", effect.alias("efeito"), sign.alias("sinal"), reference.alias("r"), (F.col("valor") * sign).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("versao", "tipo", "efeito", "sinal").agg(F.count(F.lit(1)).alias("lancamentos"), F.count("r").alias("com_referencia"), F.sum("v").cast("long").alias("valor"))


# ---------------------------------------------------------------- reconciliation

DOCS_SQL = f"{STATEMENT_SQL}, dc AS (SELECT a.entidade, a.ex, a.df, a.versao, a.coluna, (a.valor - b.valor)::BIGINT AS diferenca FROM stm a JOIN stm b ON a.entidade = b.entidade AND a.ex = b.ex AND a.df = b.df AND a.coluna = b.coluna WHERE b.versao = 'v3' AND a.coluna NOT IN ('S1', 'S2', 'S3'))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each version less those of v3, which stands for the statement."""
    rows = statement(spark, sf_dir).where(~F.col("coluna").isin("S1", "S2", "S3"))
    declared = F.max(F.when(F.col("versao") == "v3", F.col("valor"))).over(Window.partitionBy("entidade", "ex", "df", "coluna"))
    return rows.select("entidade", "ex", "df", "versao", "coluna", (F.col("valor") - declared).alias("diferenca"))


@query(f"{DOCS_SQL} SELECT entidade, ex, df, versao, count(*)::BIGINT AS comparadas, count(*) FILTER (diferenca <> 0)::BIGINT AS com_diferenca FROM dc GROUP BY ALL")
def reconciliation_index(spark, sf_dir):
    """Every document and rule with the columns compared and those that differ."""
    return _documents(spark, sf_dir).groupBy("entidade", "ex", "df", "versao").agg(F.count(F.lit(1)).alias("comparadas"), F.count_if(F.col("diferenca") != 0).alias("com_diferenca"))


@query(f"{DOCS_SQL} SELECT *, row_number() OVER (PARTITION BY entidade, ex, df, versao ORDER BY instr('abcdefghijkL', coluna))::BIGINT AS ordem FROM dc")
def reconciliation_ordered(spark, sf_dir):
    """Columns of each document in the statement's own order."""
    order = Window.partitionBy("entidade", "ex", "df", "versao").orderBy(F.instr(F.lit("abcdefghijkL"), F.col("coluna")))
    return _documents(spark, sf_dir).withColumn("ordem", F.row_number().over(order).cast("long"))


@query(f"{DOCS_SQL} SELECT versao, ex, coluna, count(*)::BIGINT AS comparacoes, count(*) FILTER (diferenca <> 0)::BIGINT AS diferencas, sum(diferenca)::BIGINT AS residuo, sum(abs(diferenca))::BIGINT AS absoluto FROM dc GROUP BY ALL")
def residual_summary(spark, sf_dir):
    """What is left between each version and the statement, by year and column."""
    d = F.col("diferenca")
    return _documents(spark, sf_dir).groupBy("versao", "ex", "coluna").agg(F.count(F.lit(1)).alias("comparacoes"), F.count_if(d != 0).alias("diferencas"), F.sum(d).cast("long").alias("residuo"), F.sum(F.abs(d)).cast("long").alias("absoluto"))


@query(f"{SNAP_SQL} SELECT event_type AS escopo, (user_id % 7)::BIGINT AS ano, arg_min(uid, (-epoch_us(ts), uid)) AS documento, max(em) AS publicado FROM snap GROUP BY ALL".replace("arg_min(uid, (-epoch_us(ts), uid))", "arg_max(uid, ts)"))
def publication_latest(spark, sf_dir):
    """The latest publication of each scope and year; of two at one instant the first."""
    newest = F.max_by(F.col("uid"), F.struct("ts", -F.col("uid")))
    return snapshots(spark, sf_dir).groupBy(F.col("event_type").alias("escopo"), (F.col("user_id") % 7).alias("ano")).agg(newest.alias("documento"), F.max("em").alias("publicado"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS primeiro, (count(*) OVER (PARTITION BY sha256(text)))::BIGINT AS copias, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS repetido FROM documents")
def documents_same_bytes(spark, sf_dir):
    """Documents of the same bytes are one: the first stands for the others."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("primeiro"), F.count(F.lit(1)).alias("copias"))
    return docs.join(first, "h").select("doc_id", "primeiro", "copias", (F.col("doc_id") != F.col("primeiro")).alias("repetido"))


# ---------------------------------------------------------------- checks, blocks, overview

#: A nature is that of one check by one version of one rule; by another, the same check isn't interpreted.
NATURES = [("pareamento de cópias", "PAR-24 v1", "conformidade"), ("colunas do demonstrativo", "RREO-COL v3", "colunas_com_diferenca"), ("demonstrativo sem corte", "CONC-RREO v2", "conformidade"), ("documentos lidos", "CONC-RREO v1", "pdfs_nao_lidos")]
CHECKS_SQL = f"""{DOCS_SQL}, ck AS (SELECT 'pareamento de cópias' AS descricao, 'PAR-24 v1' AS regra, count(*) AS verificados, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rec b WHERE b.entidade = {ORIGINALS} AND b.empenho = a.empenho - base_no AND b.ex = a.ex AND b.df = a.df AND b.anoempenho = a.anoempenho AND b.situacao = a.situacao)) AS falhas
 FROM rec a, (SELECT max(o_orderkey) // 2 AS base_no FROM orders) WHERE a.entidade = {COPIES} AND a.empenho >= base_no
 UNION ALL SELECT 'colunas do demonstrativo', 'RREO-COL ' || versao, count(*), count(*) FILTER (diferenca <> 0) FROM dc GROUP BY versao
 UNION ALL SELECT 'demonstrativo sem corte', 'CONC-RREO v1', count(*), count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) FROM orders)"""


@query(f"{CHECKS_SQL}, n(descricao, regra, natureza) AS (VALUES {_VALUES(NATURES)}) SELECT ck.descricao, ck.regra, coalesce(natureza, 'não catalogada') AS natureza, verificados::BIGINT AS verificados, falhas::BIGINT AS falhas, CASE WHEN natureza = 'conformidade' THEN falhas = 0 END AS conforme FROM ck LEFT JOIN n ON n.descricao = ck.descricao AND n.regra = ck.regra")
def checks_by_nature(spark, sf_dir):
    """Checks with what was verified and what failed, read by the nature that a catalog gives them; one that isn't in it stays uninterpreted."""
    rec, base = records(spark, sf_dir), copy_base(spark, sf_dir)
    row = lambda df, name, rule, n, bad: df.select(F.lit(name).alias("descricao"), rule.alias("regra"), F.col(n).alias("verificados"), F.col(bad).alias("falhas"))
    copies = rec.where(pair.is_copy(COPIES, base)).agg(F.count(F.lit(1)).alias("n")).crossJoin(pair.unpaired(rec, COPIES, ORIGINALS, base, MATCH).agg(F.count(F.lit(1)).alias("f")))  # one row each
    columns = _documents(spark, sf_dir).groupBy("versao").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diferenca") != 0).alias("f"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("__l")).distinct()
    orders = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__l").isNull()).alias("f"))
    found = row(copies, "pareamento de cópias", F.lit("PAR-24 v1"), "n", "f").unionByName(row(columns, "colunas do demonstrativo", F.concat(F.lit("RREO-COL "), "versao"), "n", "f")).unionByName(row(orders, "demonstrativo sem corte", F.lit("CONC-RREO v1"), "n", "f"))
    known = spark.createDataFrame(NATURES, "descricao string, regra string, natureza string")
    joined = found.join(known, ["descricao", "regra"], "left")
    return joined.select("descricao", "regra", F.coalesce("natureza", F.lit("não catalogada")).alias("natureza"), "verificados", "falhas", F.when(F.col("natureza") == "conformidade", F.col("falhas") == 0).alias("conforme"))


BLOCK_SQL = f"""{GATE_SQL}, sd AS (SELECT ex, df, entidade FROM sp WHERE estado IN ('com_dados', 'sem_rp')), yr AS (SELECT DISTINCT ex FROM sp),
pr2 AS (SELECT y.ex, a.motivo AS ma, b.motivo AS mb FROM yr y LEFT JOIN av a ON a.ex = y.ex - 1 AND a.df LIKE '%-12-31' LEFT JOIN av b ON b.ex = y.ex AND b.df LIKE '%-12-31'),
onl AS (SELECT y.ex, coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade) FILTER (NOT EXISTS (SELECT 1 FROM sd o WHERE o.ex = y.ex AND o.df LIKE '%-12-31' AND o.entidade = s.entidade)), '') AS so_antes FROM yr y LEFT JOIN sd s ON s.ex = y.ex - 1 AND s.df LIKE '%-12-31' GROUP BY y.ex),
onp AS (SELECT y.ex, coalesce(string_agg(entidade::VARCHAR, ',' ORDER BY entidade) FILTER (NOT EXISTS (SELECT 1 FROM sd o WHERE o.ex = y.ex - 1 AND o.df LIKE '%-12-31' AND o.entidade = s.entidade)), '') AS so_depois FROM yr y LEFT JOIN sd s ON s.ex = y.ex AND s.df LIKE '%-12-31' GROUP BY y.ex),
no AS (SELECT DISTINCT ex FROM sp)"""


@query(f"""{BLOCK_SQL} SELECT p.ex, so_antes, so_depois, CASE WHEN NOT EXISTS (SELECT 1 FROM no WHERE no.ex = p.ex - 1) THEN 'corte fora do universo' WHEN ma IS NOT NULL OR mb IS NOT NULL THEN 'um dos lados sem valor' WHEN so_antes <> '' OR so_depois <> '' THEN 'conjuntos de entidades diferentes' END AS motivo FROM pr2 p JOIN onl USING (ex) JOIN onp USING (ex)""")
def variation_blocks(spark, sf_dir):
    """Why a year's end can't be compared with the one before, in order: no such cut-off, a side without value, other entities on either side."""
    found, gate = _gate(spark, sf_dir)
    end = F.col("df").endswith("-12-31")
    sets = found.where(end & F.col("situacao").isin("com_dados", "sem_rp")).groupBy("ex").agg(F.collect_set("entidade").alias("e"))
    years = found.select("ex").distinct()
    at = years.join(sets, "ex", "left").join(gate.where(end).select("ex", "motivo"), "ex", "left").withColumn("e", F.coalesce("e", F.array().cast("array<bigint>")))
    before = at.select((F.col("ex") + 1).alias("ex"), F.col("e").alias("e0"), F.col("motivo").alias("m0"), F.lit(True).alias("there"))
    both = at.join(before, "ex", "left").withColumn("e0", F.coalesce("e0", F.array().cast("array<bigint>")))
    only = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)).cast("array<string>"), ",")
    lone = both.select("ex", only("e0", "e").alias("so_antes"), only("e", "e0").alias("so_depois"), "there", "m0", "motivo")
    why = F.when(F.col("there").isNull(), "corte fora do universo").when(F.col("m0").isNotNull() | F.col("motivo").isNotNull(), "um dos lados sem valor").when((F.col("so_antes") != "") | (F.col("so_depois") != ""), "conjuntos de entidades diferentes")
    return lone.select("ex", "so_antes", "so_depois", why.alias("motivo"))


@query(f"""{RECORDS}, g AS (SELECT ex, nacao, sum(s1)::BIGINT AS v FROM rec WHERE df LIKE '%-12-31' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, nacao) AS k, count(*) OVER (PARTITION BY ex) AS n FROM g),
p AS (SELECT ex, CASE WHEN n > 6 AND k > 5 THEN 'demais (' || (n - 5)::VARCHAR || ' grupos)' ELSE nacao::VARCHAR END AS grupo, sum(v)::BIGINT AS valor, min(k) AS posicao FROM r GROUP BY ALL),
t AS (SELECT *, sum(valor) OVER (PARTITION BY ex) AS total, min(valor) OVER (PARTITION BY ex) AS menor FROM p), f AS (SELECT *, CASE WHEN total > 0 AND menor >= 0 THEN valor * 1000 // total END AS fl, CASE WHEN total > 0 AND menor >= 0 THEN valor * 1000 % total END AS re FROM t)
SELECT ex, grupo, valor, posicao::BIGINT AS posicao, (fl + CASE WHEN row_number() OVER (PARTITION BY ex ORDER BY re DESC, posicao) <= 1000 - sum(fl) OVER (PARTITION BY ex) THEN 1 ELSE 0 END)::BIGINT AS decimos, CASE WHEN total > 0 THEN ((2 * valor * 1000 + total) // (2 * total))::BIGINT END AS razao FROM f""")
def overview(spark, sf_dir):
    """The opening page's partition of each year's balance: the largest groups and the rest, shares that sum to a thousand, and plain ratios."""
    g = records(spark, sf_dir).where(F.col("df").endswith("-12-31")).groupBy("ex", "nacao").agg(F.sum("s1").cast("long").alias("valor"))
    parts = ind.top_with_rest(g, ["ex"], "nacao", "valor", 5)
    shared = largest_remainder(parts, ["ex"], "valor", "posicao", "decimos").withColumn("total", F.sum("valor").over(Window.partitionBy("ex")))
    return shared.withColumn("razao", half_up_tenths("valor", "total").cast("long")).drop("total")


GROUPS = {"proc": "inscrição", "aproc": "inscrição", "pago_proc": "pagamentos", "pago_aproc": "pagamentos", "cancelado_aproc": "cancelamentos", "liquidado": "liquidação", "retencao": "retenção", "s1": "saldo"}


@query(f"""{RECORDS}, e AS (SELECT * FROM rec WHERE df LIKE '%-12-31'), d AS ({" UNION ALL ".join(f"SELECT coalesce(b.ex, a.ex + 1) AS ex, '{g}' AS grupo, coalesce(b.{f}, 0) - coalesce(a.{f}, 0) AS d FROM e a FULL JOIN e b ON a.entidade = b.entidade AND a.anoempenho = b.anoempenho AND a.empenho = b.empenho AND a.ex + 1 = b.ex" for f, g in GROUPS.items())}),
s AS (SELECT ex, grupo, sum(d)::BIGINT AS impacto, sum(abs(d))::BIGINT AS absoluto FROM d GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY ex ORDER BY absoluto DESC, grupo)::BIGINT AS posicao FROM s""")
def impact_by_group(spark, sf_dir):
    """What changed from year's end to year's end by group of money fields, the largest first."""
    end = records(spark, sf_dir).where(F.col("df").endswith("-12-31"))
    key, fields = ["entidade", "anoempenho", "empenho", "ex"], list(GROUPS)
    a = end.withColumn("ex", F.col("ex") + 1).select(*key, *[(-F.col(f)).alias(f) for f in fields])
    # earlier values negative, later positive: their sums by key are the differences, so one aggregation stands for the full outer join
    diff = a.unionByName(end.select(*key, *fields)).groupBy(*key).agg(*[F.sum(f).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grupo"), F.col(f).alias("d")) for f, g in GROUPS.items()]))
    s = diff.select("ex", each.alias("x")).groupBy("ex", "x.grupo").agg(F.sum("x.d").cast("long").alias("impacto"), F.sum(F.abs("x.d")).cast("long").alias("absoluto"))
    return s.withColumn("posicao", F.row_number().over(Window.partitionBy("ex").orderBy(F.desc("absoluto"), "grupo")).cast("long"))


@query(f"{STATEMENT_SQL}, d AS (SELECT a.entidade, a.ex, a.df, a.coluna, (b.valor - a.valor)::BIGINT AS dif FROM stm a JOIN stm b ON a.entidade = b.entidade AND a.ex = b.ex AND a.df = b.df AND a.coluna = b.coluna WHERE a.versao = 'v1' AND b.versao = 'v2') SELECT ex, df, coluna, sum(dif)::BIGINT AS diferenca, count(*) FILTER (dif <> 0)::BIGINT AS entidades FROM d GROUP BY ALL")
def column_differences(spark, sf_dir):
    """Column by column, what one version has more than another at each cut-off."""
    d = version_differences(spark, sf_dir, "v1", "v2")
    return d.groupBy("ex", "df", "coluna").agg(F.sum("diferenca").cast("long").alias("diferenca"), F.count_if(F.col("diferenca") != 0).alias("entidades"))


# ---------------------------------------------------------------- closing against opening

R7_SQL = f"""{GATE_SQL}, rp AS (SELECT ex, max(df) AS df FROM av WHERE motivo IS NULL GROUP BY ex), yr AS (SELECT DISTINCT ex FROM av),
m AS (SELECT sp.ex, sp.entidade, sp.estado FROM sp JOIN rp ON rp.ex = sp.ex AND rp.df = sp.df WHERE estado IN ('com_dados', 'sem_rp')),
yp AS (SELECT y.ex, a.df AS de, b.df AS para FROM yr y JOIN yr z ON z.ex = y.ex + 1 LEFT JOIN rp a ON a.ex = y.ex LEFT JOIN rp b ON b.ex = y.ex + 1),
ou AS (SELECT y.ex, coalesce(string_agg(m.entidade::VARCHAR, ',' ORDER BY m.entidade), '') AS saem, count(*) FILTER (m.estado = 'com_dados') AS n FROM yp y LEFT JOIN m ON m.ex = y.ex AND NOT EXISTS (SELECT 1 FROM m o WHERE o.ex = y.ex + 1 AND o.entidade = m.entidade) GROUP BY y.ex),
nw AS (SELECT y.ex, coalesce(string_agg(m.entidade::VARCHAR, ',' ORDER BY m.entidade), '') AS entram, count(*) FILTER (m.estado = 'com_dados') AS n FROM yp y LEFT JOIN m ON m.ex = y.ex + 1 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.ex = y.ex AND o.entidade = m.entidade) GROUP BY y.ex),
v AS (SELECT r.ex, sum(s1)::BIGINT AS s1, (coalesce(sum(proc) FILTER (faixa_p = 'a'), 0) + coalesce(sum(aproc) FILTER (faixa_n = 'f'), 0))::BIGINT AS af FROM rec r JOIN rp ON rp.ex = r.ex AND rp.df = r.df JOIN m ON m.ex = r.ex AND m.entidade = r.entidade GROUP BY r.ex),
t AS (SELECT yp.ex, de, para, CASE WHEN de IS NULL OR para IS NULL THEN '' ELSE saem END AS saem, CASE WHEN de IS NULL OR para IS NULL THEN '' ELSE entram END AS entram,
 CASE WHEN de IS NULL THEN 'exercício ' || yp.ex || ' sem valor' WHEN para IS NULL THEN 'exercício ' || (yp.ex + 1) || ' sem valor' WHEN ou.n + nw.n > 0 THEN 'conjunto de entidades diferente (R7)' END AS motivo FROM yp JOIN ou ON ou.ex = yp.ex JOIN nw ON nw.ex = yp.ex)"""


@query(f"""{R7_SQL} SELECT t.*, CASE WHEN motivo IS NULL THEN a.s1 END AS s1, CASE WHEN motivo IS NULL THEN b.af END AS abertura, CASE WHEN motivo IS NULL THEN (b.af - a.s1)::BIGINT END AS diferenca FROM t LEFT JOIN v a ON a.ex = t.ex LEFT JOIN v b ON b.ex = t.ex + 1""")
def closing_opening_total(spark, sf_dir):
    """The Municipality's opening of a year less its closing of the year before, each at the last cut-off whose total may be formed; no value where either has none, or where
    entities with records enter or leave in between (R7)."""
    found, gate = _gate(spark, sf_dir)
    chosen = cut(gate.where("motivo is null").groupBy("ex").agg(F.max("df").alias("df")))
    inside = found.where(F.col("situacao").isin("com_dados", "sem_rp")).join(chosen, ["ex", "df"]).select("ex", "df", "entidade", (F.col("situacao") == "com_dados").alias("tem"))
    sums = records(spark, sf_dir).join(inside.select("entidade", "ex", "df"), ["entidade", "ex", "df"], "left_semi").groupBy("ex").agg(
        F.sum("s1").cast("long").alias("s1"), (F.sum(F.when(F.col("faixa_p") == "a", F.col("proc")).otherwise(0)) + F.sum(F.when(F.col("faixa_n") == "f", F.col("aproc")).otherwise(0))).cast("long").alias("af")
    )
    # entities of a year: a few for each, gathered as maps of entity and whether it has records
    who = inside.groupBy("ex").agg(F.map_from_entries(F.collect_list(F.struct("entidade", "tem"))).alias("quem"))
    years = gate.select("ex").distinct().join(chosen, "ex", "left").join(who, "ex", "left").join(sums, "ex", "left")
    nxt = years.select((F.col("ex") - 1).alias("ex"), F.col("df").alias("para"), F.col("quem").alias("depois"), F.col("af").alias("abertura"))
    p = years.select("ex", F.col("df").alias("de"), F.col("quem").alias("antes"), "s1").join(nxt, "ex")
    apart = lambda x, y: F.map_filter(F.col(x), lambda k, _: ~F.array_contains(F.map_keys(F.col(y)), k))
    p = p.withColumns({"sai": apart("antes", "depois"), "entra": apart("depois", "antes")})
    names = lambda m: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: k.cast("string")), ","), F.lit(""))
    differs = F.exists(F.concat(F.map_values("sai"), F.map_values("entra")), lambda t: t)
    none = lambda y: F.concat(F.lit("exercício "), y.cast("string"), F.lit(" sem valor"))
    why = F.when(F.col("de").isNull(), none(F.col("ex"))).when(F.col("para").isNull(), none(F.col("ex") + 1)).when(differs, "conjunto de entidades diferente (R7)")
    p = p.withColumn("motivo", why)
    good = lambda c: F.when(F.col("motivo").isNull(), c)
    return p.select("ex", "de", "para", names("sai").alias("saem"), names("entra").alias("entram"), "motivo", good(F.col("s1")).alias("s1"), good(F.col("abertura")).alias("abertura"), good(F.col("abertura") - F.col("s1")).alias("diferenca"))
