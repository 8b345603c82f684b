"""Movements of commitments, details with them, and inquiries into statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inquiry as inq
from ..operators import integrity as integ
from ..operators import pairing as pair
from ..operators.rules import MOVEMENT_CODES, long_columns, statement_columns
from ..sources import movements as mov
from ..sources.ledger import read, tasks
from .audit import STATES_SQL, states
from .history import SNAP_SQL, snapshots
from .indicators import COPIES, ORIGINALS, STATEMENT_SQL, copy_base, records, statement
from .panel import DOCS_SQL, _documents
from .registry import RECORDS, query
from .relations import DECISIONS_SQL, FIRST, MATCH, PAIRS_SQL, _pairs, decisions

# ---------------------------------------------------------------- movements

CODES = list(MOVEMENT_CODES) + [99]
#: One line in 13 has a text for its value, one none, one null, one three decimals.
BROKEN = {0: '"x"', 1: None, 2: "null"}
LINES_SQL = f"""ln AS (SELECT l_orderkey AS empenho, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS indice, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS rf, l_shipdate::DATE AS data, round(l_extendedprice * 100)::BIGINT AS v, round(l_quantity * 100)::BIGINT AS q, {CODES}[(l_orderkey + l_linenumber) % {len(CODES)} + 1]::BIGINT AS tipo FROM lineitem),
mv AS (SELECT empenho, indice, data, tipo, CASE WHEN n % 5 = 0 THEN '' ELSE 'lançamento ' || rf END AS descricao, v AS valor_c, CASE WHEN n % 2 = 1 THEN q END AS a_liquidar_c, CASE WHEN n % 3 <> 0 THEN q END AS a_pagar_c, 1995 + s % 5 AS liquidacao_ex, s AS liquidacao_no, CASE WHEN tipo IN (40, 41) AND n <> 4 THEN 1996 + s % 5 END AS pagamento_ex, CASE WHEN tipo IN (40, 41) THEN p END AS pagamento_no, 'D' || p AS documento FROM ln WHERE p % 13 > 3),
ef AS (SELECT *, coalesce(CASE tipo {" ".join(f"WHEN {c} THEN '{e}'" for c, (e, _) in MOVEMENT_CODES.items())} END, 'desconhecido') AS efeito, (valor_c * coalesce(CASE tipo {" ".join(f"WHEN {c} THEN {s}" for c, (_, s) in MOVEMENT_CODES.items())} END, 0))::BIGINT AS com_sinal_c,
 CASE WHEN tipo IN (40, 41) THEN pagamento_no || '/' || pagamento_ex WHEN tipo IN (30, 31, 33, 50, 51) THEN liquidacao_no || '/' || liquidacao_ex END AS referencia FROM mv)"""


def movement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(empenho, body): a page for each commitment, one item for each of its lines; some values are absent, null, texts, or have three decimals, labels have white space around them."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), ((F.col("l_orderkey") + n) % len(CODES) + 1).cast("int"))
    text, field = (lambda c: c.cast("string")), (lambda name, v: F.concat(F.lit(f'"{name}":'), v))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)"), text(F.col("l_quantity").cast("decimal(18,2)"))
    value = F.when(p % 13 == 0, '"x"').when(p % 13 == 1, F.lit(None)).when(p % 13 == 2, "null").when(p % 13 == 3, F.concat(text(price), F.lit("4"))).otherwise(text(price))
    paid = code.isin(40, 41)
    parts = [
        field("data", quoted(F.date_format("l_shipdate", "yyyy-MM-dd"))), field("tipoLancamento", text(code)), F.when(n % 5 != 0, field("descricaoTipoLancamento", quoted(F.concat(F.lit("  \\t lançamento "), "l_returnflag", F.lit(" \\n "))))), field("valor", value),
        F.when(n % 2 == 1, field("valorALiquidar", quantity)), field("valorAPagar", F.when(n % 3 == 0, "null").otherwise(quantity)), field("exercicioLiquidacao", text(s % 5 + 1995)), field("noLiquidacao", text(s)),
        F.when(paid & (n != 4), field("exercicioPagamento", text(s % 5 + 1996))), F.when(paid, field("noPagamento", text(p))), field("nroDocumento", quoted(F.concat(F.lit("D"), text(p)))),
    ]
    item = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("empenho"), F.struct(n.alias("n"), p.alias("p"), s.alias("s"), item.alias("r")).alias("x")).repartition(tasks(spark, sf_dir), "empenho")
    content = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), ",")  # the lines of one order
    return rows.groupBy("empenho").agg(F.concat(F.lit('{"content":['), content, F.lit("]}")).alias("body"))


@query(f"WITH {LINES_SQL} SELECT empenho, indice::BIGINT AS indice, strftime(data, '%Y-%m-%d') AS data, tipo, descricao, valor_c, a_liquidar_c, a_pagar_c, liquidacao_ex, liquidacao_no, pagamento_ex, pagamento_no, documento, efeito, com_sinal_c, referencia FROM ef")
def movement_entries(spark, sf_dir):
    """Every entry of every movement page: its fields, and by rule what it does and refers to."""
    return mov.entries(movement_pages(spark, sf_dir), ["empenho"]).withColumns({"data": F.date_format("data", "yyyy-MM-dd"), "indice": F.col("indice").cast("long")})


@query(f"WITH {LINES_SQL} SELECT empenho, indice::BIGINT AS indice, CASE p % 13 WHEN 1 THEN 'ausente' WHEN 2 THEN 'nulo' ELSE 'invalido' END AS motivo FROM ln WHERE p % 13 <= 3")
def movement_refusals(spark, sf_dir):
    return mov.refused(movement_pages(spark, sf_dir), ["empenho"]).withColumn("indice", F.col("indice").cast("long"))


HASHED = ["entidade", "anoempenho", "empenho", "ex", "df", "proc", "aproc", "s1"]
OUT_COPY = f"cópia anterior a {FIRST}: fora dos indicadores; o registro continua no bruto e no pareamento"
OUT_ORIGINAL = "original de um par: no Município o RP é contado uma vez, na cópia"


@query(f"""{STATES_SQL}, half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), {LINES_SQL}, me AS (SELECT empenho, count(*)::BIGINT AS lancamentos, sum(com_sinal_c)::BIGINT AS movimentado FROM ef GROUP BY empenho),
lc AS (SELECT entidade, ex, max(df) AS df FROM st WHERE situacao IN ('com_dados', 'sem_rp') GROUP BY ALL), d AS (SELECT r.*, base_no FROM rec r JOIN lc ON lc.entidade = r.entidade AND lc.ex = r.ex AND lc.df = r.df, half)
SELECT d.entidade, d.ex, d.df, d.anoempenho, d.empenho, d.categoria, d.s1, d.s2, d.s3, CASE WHEN d.entidade = {COPIES} AND d.empenho >= base_no AND d.ex < {FIRST} THEN '{OUT_COPY}'
 WHEN d.entidade = {ORIGINALS} AND d.pago_proc = 0 AND d.pago_aproc = 0 AND d.cancelado_aproc = 0 AND d.liquidado = 0 AND EXISTS (SELECT 1 FROM rec a WHERE a.entidade = {COPIES} AND a.ex >= {FIRST} AND a.empenho >= d.base_no AND a.empenho = d.empenho + d.base_no AND a.anoempenho = d.anoempenho AND a.ex = d.ex AND a.df = d.df AND a.proc = d.proc AND a.aproc = d.aproc AND a.situacao IS NOT DISTINCT FROM d.situacao) THEN '{OUT_ORIGINAL}' END AS fora_do_indicador,
 coalesce(lancamentos, 0)::BIGINT AS lancamentos, movimentado, CASE WHEN lancamentos IS NULL THEN 'movimentação deste empenho não coletada' END AS nota, sha256(concat_ws(chr(31), {", ".join(f"'=' || d.{c}" for c in HASHED)})) AS registro
FROM d LEFT JOIN me ON me.empenho = d.empenho""")
def commitment_whole(spark, sf_dir):
    """Every commitment at its entity's last cut-off of the year: derived values, why it is outside the Municipality's indicators, its movements, and the hash that leads to the record."""
    from ..functions.text import row_hash

    rec, base = records(spark, sf_dir), copy_base(spark, sf_dir)
    last = states(spark, sf_dir).where(F.col("situacao").isin("com_dados", "sem_rp")).groupBy("entidade", "ex").agg(F.max("df").alias("df"))
    chosen = rec.join(F.broadcast(last), ["entidade", "ex", "df"], "left_semi")  # a row for each entity and year
    point = ["ex", "df", "anoempenho", "empenho", "proc", "aproc"]
    copies = rec.where(pair.is_copy(COPIES, base) & (F.col("ex") >= FIRST)).select(F.lit(ORIGINALS).cast("long").alias("entidade"), (F.col("empenho") - base).alias("empenho"), *[c for c in point if c != "empenho"], F.col("situacao").alias("__s"), F.lit(True).alias("__copy"))
    joined = chosen.repartition(tasks(spark, sf_dir), "entidade", *point).join(copies.hint("merge"), ["entidade", *point], "left")
    replaced = F.col("__copy").isNotNull() & F.col("__s").eqNullSafe(F.col("situacao")) & (pair.execution() == 0)
    out = F.when(pair.is_copy(COPIES, base) & (F.col("ex") < FIRST), OUT_COPY).when(replaced, OUT_ORIGINAL)
    moved = mov.entries(movement_pages(spark, sf_dir), ["empenho"]).groupBy("empenho").agg(F.count(F.lit(1)).alias("__n"), F.sum("com_sinal_c").cast("long").alias("movimentado"))
    note = F.when(F.col("__n").isNull(), "movimentação deste empenho não coletada")
    # every commitment has its movements: sums of more rows than the files' size tells, so they are merged and never sent whole
    return joined.withColumn("fora_do_indicador", out).join(moved.hint("merge"), "empenho", "left").select("entidade", "ex", "df", "anoempenho", "empenho", "categoria", "s1", "s2", "s3", "fora_do_indicador", F.coalesce("__n", F.lit(0)).cast("long").alias("lancamentos"), "movimentado", note.alias("nota"), row_hash(*HASHED).alias("registro"))


# ---------------------------------------------------------------- statements

_CAND_SQL = "c AS (SELECT entidade, ex, df, " + ", ".join(f"sum({inq.candidate(c)})::BIGINT AS {c}" for c in inq.CANDIDATES) + " FROM rec GROUP BY ALL)"
_CAND_LONG = " UNION ALL ".join(f"SELECT entidade, ex, df, '{c}' AS coluna, ({x})::BIGINT AS candidato FROM c" for c, x in [*((c, c) for c in inq.CANDIDATES), ("e", "a + b - c - d"), ("k", "f + g - i - j")])


@query(f"{STATEMENT_SQL}, {_CAND_SQL}, cl AS ({_CAND_LONG}) SELECT cl.*, s.valor AS declarado, (candidato - s.valor)::BIGINT AS diferenca FROM cl JOIN stm s ON s.entidade = cl.entidade AND s.ex = cl.ex AND s.df = cl.df AND s.coluna = cl.coluna WHERE s.versao = 'v3'")
def candidate_columns(spark, sf_dir):
    """Each column's candidate sum over the tabs against the statement (v3): the difference says whether the candidate's rule holds."""
    key = ["entidade", "ex", "df"]
    found = inq.candidate_sums(records(spark, sf_dir), key)
    declared = statement(spark, sf_dir, ("v3",)).select(*key, "coluna", F.col("valor").alias("declarado"))
    return found.join(declared, [*key, "coluna"]).withColumn("diferenca", F.col("candidato") - F.col("declarado"))


#: A cell that a declaration leaves out though it isn't zero, for some lines; others leave out zeros.
LOST = "(entidade + ex) % 6 = 0"
_WIDE_SQL = lambda v: f"SELECT entidade, ex, df, {', '.join(f"max(valor) FILTER (coluna = '{c}') AS \"{c}\"" for c in inq.CELLS)} FROM stm WHERE versao = '{v}' GROUP BY ALL"
_Q = {c: f'"{c}"' for c in inq.CELLS}
_HOLDS = {r: (f'coalesce("{r}", 0)', "".join(f'coalesce("{x}", 0)' if x in inq.CELLS else x for x in t), t) for r, t in inq.IDENTITIES}
DECLARED_SQL = f"""{STATEMENT_SQL}, w3 AS ({_WIDE_SQL("v3")}), de AS (SELECT entidade, ex, df, {", ".join(f'CASE WHEN "{c}" <> 0' + (f" AND NOT {LOST}" if c == "b" else "") + f' THEN "{c}" END AS "{c}"' for c in inq.CELLS)} FROM w3),
df1 AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN \"{c}\" IS NULL THEN '{c}' END" for c in inq.CELLS)}], lambda x: x IS NOT NULL), ',') AS ausentes, CASE {" ".join(f"WHEN {a} <> {b} THEN '{r} = {t}'" for r, (a, b, t) in _HOLDS.items())} END AS quebra FROM de),
dz AS (SELECT *, CASE WHEN ausentes <> '' AND quebra IS NOT NULL THEN 'ausentes sem fechar: ' || ausentes ELSE quebra END AS falha FROM df1)"""


def _wide(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    return statement_columns(records(spark, sf_dir), ["entidade", "ex", "df"], (version,)).select("entidade", "ex", "df", *inq.CELLS)


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations: the statement (v3) as its source writes it, without the cells that are zero, and some without one that isn't."""
    shown = lambda c: F.when((F.col(c) != 0) & (F.lit(True) if c != "b" else ~F.expr(LOST)), F.col(c))
    return inq.zero_absent(_wide(spark, sf_dir, "v3").withColumns({c: shown(c) for c in inq.CELLS}))


@query(f"{DECLARED_SQL} SELECT entidade, ex, df, ausentes, falha, {', '.join(f'(CASE WHEN falha IS NULL THEN coalesce({q}, 0) ELSE {q} END)::BIGINT AS {q}' for q in _Q.values())} FROM dz")
def declared_cells(spark, sf_dir):
    """Declarations with their absent cells: zero where the line closes so, else a failure that names them."""
    return _declared(spark, sf_dir)


@query(f"""{DECLARED_SQL}, dl AS ({" UNION ALL ".join(f"SELECT entidade, ex, df, '{c}' AS coluna, CASE WHEN falha IS NULL THEN coalesce({q}, 0) ELSE {q} END AS d FROM dz" for c, q in _Q.items())}), rl AS (SELECT entidade, ex, df, coluna, valor FROM stm WHERE versao = 'v2' AND coluna IN ({", ".join(f"'{c}'" for c in inq.CELLS)}))
SELECT entidade, ex, df, count(d)::BIGINT AS comparadas, count(*) FILTER ((d IS NOT NULL AND d <> valor) OR (d IS NULL AND valor <> 0))::BIGINT AS diferentes, count(d) > 0 AND count(*) FILTER ((d IS NOT NULL AND d <> valor) OR (d IS NULL AND valor <> 0)) = 0 AS igual FROM rl LEFT JOIN dl USING (entidade, ex, df, coluna) GROUP BY ALL""")
def declaration_compared(spark, sf_dir):
    """Printed statements (v2) against declarations, cell by cell."""
    key = ["entidade", "ex", "df"]
    printed = _wide(spark, sf_dir, "v2").unpivot(key, list(inq.CELLS), "coluna", "valor")
    told = _declared(spark, sf_dir).unpivot(key, list(inq.CELLS), "coluna", "valor").where("valor is not null")
    return inq.cells_compared(printed, told, key, ["coluna"])


#: What a second reading misses (a whole line, one cell) and misreads.
NO_LINE, NO_CELL, MISREAD = "(entidade + ex) % 5 = 0", "(entidade + ex) % 7 = 1 AND coluna = 'c'", "(entidade * ex) % 9 = 4 AND coluna = 'g'"
_CELLS_IN = ", ".join(f"'{c}'" for c in inq.CELLS)


@query(f"""{STATEMENT_SQL}, r1 AS (SELECT ex, df, entidade::VARCHAR AS linha, coluna, valor, entidade FROM stm WHERE versao = 'v3' AND coluna IN ({_CELLS_IN})), r2 AS (SELECT ex, df, linha, coluna, CASE WHEN {MISREAD} THEN valor + 1 ELSE valor END AS s FROM r1 WHERE NOT ({NO_LINE}) AND NOT ({NO_CELL})),
ll AS (SELECT DISTINCT ex, df, linha FROM r2), dc AS (SELECT ex, df, entidade::VARCHAR AS linha, coluna, valor AS d FROM stm WHERE versao = 'v2' AND coluna IN ({_CELLS_IN}) AND entidade <> 3),
j AS (SELECT r1.*, ll.linha IS NOT NULL AS la, s, d FROM r1 LEFT JOIN ll ON ll.ex = r1.ex AND ll.df = r1.df AND ll.linha = r1.linha LEFT JOIN r2 ON r2.ex = r1.ex AND r2.df = r1.df AND r2.linha = r1.linha AND r2.coluna = r1.coluna LEFT JOIN dc ON dc.ex = r1.ex AND dc.df = r1.df AND dc.linha = r1.linha AND dc.coluna = r1.coluna),
g AS (SELECT ex, df, count(*)::BIGINT AS celulas, count(*) FILTER (la)::BIGINT AS conferidas, count(*) FILTER (la AND s IS DISTINCT FROM valor)::BIGINT AS divergentes, coalesce(string_agg(DISTINCT linha, ',' ORDER BY linha) FILTER (NOT la), '') AS sem_segunda_leitura, count(*) FILTER (entidade <> 3 AND d IS DISTINCT FROM valor)::BIGINT AS conteudo_diferente FROM j GROUP BY ALL)
SELECT *, CASE WHEN divergentes = 0 AND sem_segunda_leitura = '' AND conferidas > 0 THEN 'validado' ELSE 'divergente' END AS situacao FROM g""")
def layouts_validated(spark, sf_dir):
    """Statements read by rule, against a second reading and against declarations, line by line (a line for each entity)."""
    long = lambda v: long_columns(statement_columns(records(spark, sf_dir), ["entidade", "ex", "df"], (v,)), ["entidade", "ex", "df"]).where(F.col("coluna").isin(*inq.CELLS))
    first = long("v3")
    second = first.where(f"not ({NO_LINE}) and not ({NO_CELL})").withColumn("valor", F.when(F.expr(MISREAD), F.col("valor") + 1).otherwise(F.col("valor")))
    line = lambda df: df.select("ex", "df", F.col("entidade").cast("string").alias("linha"), "coluna", "valor")
    return inq.layouts_validated(line(first), line(second), line(long("v2").where("entidade <> 3")), ["ex", "df"], "linha", "coluna")


@query(f"""{SNAP_SQL}, e AS (SELECT event_type AS parte, uid, CASE WHEN uid % 2 = 0 THEN em END AS texto, CASE WHEN uid % 2 = 1 THEN valor END AS numero FROM snap), a AS (SELECT * FROM e WHERE uid % 17 <> 3), b AS (SELECT parte, uid, CASE WHEN texto IS NOT NULL AND uid % 40 = 0 THEN texto || '!' ELSE texto END AS texto, CASE WHEN numero IS NOT NULL AND uid % 31 = 0 THEN numero + 1 ELSE numero END AS numero FROM e WHERE uid % 23 <> 5),
j AS (SELECT coalesce(a.parte, b.parte) AS parte, CASE WHEN a.uid IS NULL THEN 'novos' WHEN b.uid IS NULL THEN 'removidos' WHEN a.texto IS NOT DISTINCT FROM b.texto AND a.numero IS NOT DISTINCT FROM b.numero THEN 'iguais' WHEN coalesce(a.texto, b.texto) IS NOT NULL THEN 'textos' ELSE 'valores' END AS k FROM a FULL JOIN b ON a.parte = b.parte AND a.uid = b.uid),
g AS (SELECT parte, {", ".join(f"count(*) FILTER (k = '{k}')::BIGINT AS {k}" for k in ("iguais", "valores", "textos", "novos", "removidos"))} FROM j GROUP BY parte) SELECT *, valores + textos + novos + removidos = 0 AS identico FROM g""")
def states_compared(spark, sf_dir):
    """Two states of the panel, each entry a number or a text: what stayed, changed, came and went, by part."""
    u = F.col("uid")
    e = snapshots(spark, sf_dir).select(F.col("event_type").alias("parte"), "uid", F.when(u % 2 == 0, F.col("em")).alias("texto"), F.when(u % 2 == 1, F.col("valor")).alias("numero"))
    after = e.where("uid % 23 <> 5").withColumns({"texto": F.when(u % 40 == 0, F.concat("texto", F.lit("!"))).otherwise(F.col("texto")), "numero": F.when(u % 31 == 0, F.col("numero") + 1).otherwise(F.col("numero"))})
    return inq.states_compared(e.where("uid % 17 <> 3"), after, ["parte"], ["uid"])


# ---------------------------------------------------------------- views by version, notes, pendencies

_RULE = {"v1": "click/1", "v2": "click/2", "v3": "click/3"}
_PAIR_RULE = {"v1": "view/1", "v2": "view/2", "v4": "view/0"}
_EXCLUDED = {"v1": "CASE WHEN relacao = 'igual' THEN 'b' END", "v2": "CASE WHEN relacao IN ('igual', 'a_e_saldo_final_de_b') THEN 'a' END", "v4": "CASE WHEN relacao = 'igual' AND lado IN ('A', 'nenhum') THEN 'b' END"}
_ADJ_PARTS = [("CASE WHEN ul THEN 'b' ELSE 'a' END", "greatest(p, 0)"), ("CASE WHEN ul THEN 'g' ELSE 'f' END", "greatest(n, 0)"), ("'e'", "greatest(p, 0)"), ("'k'", "greatest(n, 0)"), ("'L'", "greatest(p, 0) + greatest(n, 0)"), ("'S1'", "p + n"), ("'S2'", "n"), ("'S3'", "p")]
VIEWS_SQL = f"""{STATEMENT_SQL}, {PAIRS_SQL.removeprefix(RECORDS + ", ")}, {DECISIONS_SQL.removeprefix("WITH ")}, gv AS (SELECT regra, arg_max(situacao, ts) AS situacao FROM dec GROUP BY regra),
mu AS (SELECT ex, df, versao, coluna, sum(valor)::BIGINT AS valor FROM stm GROUP BY ALL), fx AS ({" UNION ALL ".join(f"SELECT '{v}' AS par, ex, df, anoempenho = ex - 1 AS ul, CASE WHEN lado <> 'ambos' THEN {x} END AS fora, a_proc, a_aproc, b_proc, b_aproc FROM pr" for v, x in _EXCLUDED.items())}),
fy AS (SELECT par, ex, df, ul, CASE WHEN fora = 'a' THEN a_proc ELSE b_proc END AS p, CASE WHEN fora = 'a' THEN a_aproc ELSE b_aproc END AS n FROM fx WHERE fora IS NOT NULL),
aj AS (SELECT par, ex, df, coluna, sum(x)::BIGINT AS ajuste FROM ({" UNION ALL ".join(f"SELECT par, ex, df, {c} AS coluna, -({a}) AS x FROM fy" for c, a in _ADJ_PARTS)}) GROUP BY ALL),
vw AS (SELECT 'publicado' AS visao, versao AS agregacao, NULL AS consolidacao, ex, df, coluna, valor FROM mu UNION ALL SELECT 'analitico', 'v2', k.par, mu.ex, mu.df, mu.coluna, (valor + coalesce(ajuste, 0))::BIGINT FROM mu, (VALUES ('v1'), ('v2'), ('v4')) k(par) LEFT JOIN aj ON aj.par = k.par AND aj.ex = mu.ex AND aj.df = mu.df AND aj.coluna = mu.coluna WHERE mu.versao = 'v2')"""
_MAP = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query(f"""{VIEWS_SQL} SELECT visao, agregacao, consolidacao, ex, df, coluna, valor, a.situacao AS situacao_agregacao, c.situacao AS situacao_consolidacao, CASE WHEN visao = 'publicado' AND a.situacao = 'operacional' THEN 'derivado' ELSE 'analitico' END AS natureza
FROM vw LEFT JOIN gv a ON a.regra = {_MAP("agregacao", _RULE)} LEFT JOIN gv c ON c.regra = {_MAP("consolidacao", _PAIR_RULE)}""")
def analytical_views(spark, sf_dir):
    """All views of the Municipality's columns: each version as published, and the pairs consolidated by each version, with both rules' standing. Only a published view whose rule is in operation is derived."""
    city = statement(spark, sf_dir).groupBy("ex", "df", "versao", "coluna").agg(F.sum("valor").cast("long").alias("valor"))
    found = _pairs(spark, sf_dir)
    views = city.select(F.lit("publicado").alias("visao"), F.col("versao").alias("agregacao"), F.lit(None).cast("string").alias("consolidacao"), "ex", "df", "coluna", "valor")
    base = city.where("versao = 'v2'")
    for v in _PAIR_RULE:
        less = pair.adjustments(found, v)
        one = base.join(less, ["ex", "df", "coluna"], "left").select(F.lit("analitico").alias("visao"), F.lit("v2").alias("agregacao"), F.lit(v).alias("consolidacao"), "ex", "df", "coluna", (F.col("valor") + F.coalesce("ajuste", F.lit(0))).cast("long").alias("valor"))
        views = views.unionByName(one)
    standing = integ.decisions_as_of(decisions(spark, sf_dir), "regra", "ts", "uid", ["situacao"])
    name = lambda c, m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c))
    side = lambda n: standing.select(F.col("regra").alias(f"__{n}"), F.col("situacao").alias(f"situacao_{n}"))
    joined = views.withColumns({"__agregacao": name("agregacao", _RULE), "__consolidacao": name("consolidacao", _PAIR_RULE)}).join(side("agregacao"), "__agregacao", "left").join(side("consolidacao"), "__consolidacao", "left")
    return joined.withColumn("natureza", inq.view_nature(F.col("visao"), [F.col("situacao_agregacao")])).drop("__agregacao", "__consolidacao")


#: A source and a prefix of the element of expense that the notes single out; an entity that they leave out.
SOURCE, ELEMENT, OUTSIDE = 3, "MACH", 3
_NEW = "anoempenho = ex - 1"
NOTES = {"inscricao": ("true", "proc + aproc"), "novos": (_NEW, "proc + aproc"), "novos_mai_dez": (f"{_NEW} AND mes >= 5", "proc + aproc"), "novos_da_fonte": (f"{_NEW} AND nacao = {SOURCE}", "proc + aproc"), "novos_do_elemento": (f"{_NEW} AND segmento LIKE '{ELEMENT}%'", "proc + aproc"), "novos_processados": (_NEW, "proc"), "novos_nao_processados": (_NEW, "aproc"),
         "folha_dezembro_pago": (f"{_NEW} AND mes = 12 AND segmento LIKE '{ELEMENT}%'", "pago_proc + pago_aproc"), "fonte_cancelado": (f"{_NEW} AND nacao = {SOURCE}", "cancelado_proc + cancelado_aproc")}
_NOTE = lambda n: f"sum(CASE WHEN {NOTES[n][0]} THEN {NOTES[n][1]} ELSE 0 END)"


@query(f"{RECORDS}, half AS (SELECT max(o_orderkey) // 2 AS base_no FROM orders), x AS (SELECT rec.*, month(o_orderdate) AS mes FROM rec JOIN orders ON o_orderkey = empenho, half WHERE entidade <> {OUTSIDE} AND NOT (entidade = {COPIES} AND empenho >= base_no AND ex < {FIRST})) SELECT ex, df, {', '.join(f'{_NOTE(n)}::BIGINT AS {n}' for n in NOTES)} FROM x GROUP BY ALL")
def inscription_notes(spark, sf_dir):
    """The sums that explain a year's inscription: what is new, by month of emission, source and element, what was paid and cancelled of it; copies outside the scope and one entity are left out."""
    months = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("empenho"), F.month("o_orderdate").alias("mes"))
    inside = records(spark, sf_dir).where((F.col("entidade") != OUTSIDE) & ~(pair.is_copy(COPIES, copy_base(spark, sf_dir)) & (F.col("ex") < FIRST)))
    # one row for each commitment and cut-off, met by number: months are few bytes beside the records
    return inside.join(months, "empenho").groupBy("ex", "df").agg(*[F.expr(_NOTE(n)).cast("long").alias(n) for n in NOTES])


IN_USE = [*_RULE.values(), *_PAIR_RULE.values(), "sem decisão/9"]


@query(f"""{DOCS_SQL}, {PAIRS_SQL.removeprefix(RECORDS + ", ")}, {DECISIONS_SQL.removeprefix("WITH ")}, {STATES_SQL.removeprefix(RECORDS + ", ")}
SELECT 'divergencia' AS tipo, versao AS chave, count(*)::BIGINT AS linhas, count(DISTINCT (entidade, ex, df))::BIGINT AS documentos FROM dc WHERE diferenca <> 0 GROUP BY versao
UNION ALL SELECT 'nao_coletado', ex::VARCHAR, count(*)::BIGINT, count(*)::BIGINT FROM st WHERE situacao = 'sem_coleta' GROUP BY ex
UNION ALL SELECT 'pares', NULL, count(*)::BIGINT, count(DISTINCT (anoempenho, a_empenho))::BIGINT FROM pr HAVING count(*) > 0
UNION ALL SELECT 'regra_sem_decisao', regra, 1, 0 FROM (VALUES {", ".join(f"('{r}')" for r in IN_USE)}) u(regra) WHERE regra NOT IN (SELECT regra FROM dec WHERE ts <= TIMESTAMP '2024-01-10 23:59:59')""")
def pendencies(spark, sf_dir):
    """What is still open, shown and never a failure: columns that differ by rule and in how many documents, cut-offs not collected by year, pairs of undetermined nature (rows, and commitments), and rules in use that nobody has decided on by an instant."""
    row = lambda df, kind, key, lines, docs: df.select(F.lit(kind).alias("tipo"), key.cast("string").alias("chave"), lines.cast("long").alias("linhas"), docs.cast("long").alias("documentos"))
    c = F.col
    differ = _documents(spark, sf_dir).where("diferenca <> 0").groupBy("versao", "entidade", "ex", "df").agg(F.count(F.lit(1)).alias("n")).groupBy("versao").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    missing = states(spark, sf_dir).where("situacao = 'sem_coleta'").groupBy("ex").agg(F.count(F.lit(1)).alias("n"))
    both = _pairs(spark, sf_dir).groupBy("anoempenho", "a_empenho").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).where("d > 0")
    decided = decisions(spark, sf_dir).where(c("ts") <= F.lit("2024-01-10 23:59:59").cast("timestamp")).select("regra").distinct()
    used = spark.createDataFrame([(r,) for r in IN_USE], "regra string").join(decided, "regra", "left_anti")
    return row(differ, "divergencia", c("versao"), c("n"), c("d")).unionByName(row(missing, "nao_coletado", c("ex"), c("n"), c("n"))).unionByName(row(both, "pares", F.lit(None), c("n"), c("d"))).unionByName(row(used, "regra_sem_decisao", c("regra"), F.lit(1), F.lit(0)))
