"""Cases of an investigation, runs compared by content, personal data, and nested shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents, format_cents
from ..functions.text import CPF_EXAMPLES, personal_data_in
from ..operators import identity
from ..operators.integrity import table_differences
from ..sources import shapes, statements
from ..sources.ledger import CUTOFF, read, tasks
from ..sources.store import cut
from .indicators import STATEMENT_SQL, records, statement
from .registry import RECORDS, query

GROUP, KEY = ["entidade", *CUTOFF], ["anoempenho", "empenho"]
_P, _N = "proc > 0 AND aproc = 0", "aproc > 0 AND proc = 0"
#: The cases, in order.
CASES = {
    "A processado sem pagamento": f"{_P} AND pago_proc = 0 AND cancelado_aproc = 0 AND liquidado = 0 AND pago_aproc = 0 AND pago_proc_estornado = 0",
    "B1 processado pago integralmente": f"{_P} AND pago_proc = proc",
    "B2 processado pago parcialmente": f"{_P} AND pago_proc > 0 AND pago_proc < proc",
    "C processado com cancelamento": f"{_P} AND cancelado_aproc > 0",
    "D1 processado com pagamento estornado": "proc > 0 AND pago_proc_estornado > 0",
    "D2 processado com estorno de liquidação sem cancelamento": f"{_P} AND liquidado < 0 AND cancelado_aproc = 0",
    "E não processado sem liquidação": f"{_N} AND liquidado = 0 AND pago_aproc = 0 AND cancelado_aproc = 0",
    "F não processado parcialmente liquidado": f"{_N} AND liquidado > 0 AND liquidado < aproc AND cancelado_aproc = 0",
    "G não processado liquidado e pago": f"{_N} AND pago_aproc > 0 AND pago_aproc = liquidado AND liquidado = aproc",
    "G2 não processado liquidado, pago em parte": f"{_N} AND pago_aproc > 0 AND pago_aproc < liquidado",
    "G3 não processado com pagamento estornado": "aproc > 0 AND pago_aproc_estornado > 0",
    "H1 nas duas abas": "proc > 0 AND aproc > 0",
    "H2 nas duas abas, com pagamento dos dois tipos": "proc > 0 AND aproc > 0 AND pago_proc > 0 AND pago_aproc > 0",
    "I1 não processado cancelado em parte e liquidado": "aproc > 0 AND cancelado_aproc > 0 AND liquidado > 0",
    "I2 pago sem processado": "proc = 0 AND pago_proc <> 0",
    "I3 retenção": "retencao > 0 AND proc = 0",
}


def _chain_sql() -> str:
    """Each case in turn: the first key that meets it and isn't among those of the cases before."""
    parts = [f"{RECORDS}, k0 AS (SELECT NULL::BIGINT AS entidade, NULL::BIGINT AS ex, NULL::VARCHAR AS df, NULL::VARCHAR AS caso, NULL::BIGINT AS anoempenho, NULL::BIGINT AS empenho WHERE false)"]
    for i, (name, cond) in enumerate(CASES.items(), 1):
        parts.append(f"""k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL SELECT entidade, ex, df, '{name}', anoempenho, empenho FROM (SELECT entidade, ex, df, anoempenho, empenho FROM rec r WHERE {cond}
 AND NOT EXISTS (SELECT 1 FROM k{i - 1} u WHERE u.entidade = r.entidade AND u.ex = r.ex AND u.df = r.df AND u.anoempenho = r.anoempenho AND u.empenho = r.empenho)
 QUALIFY row_number() OVER (PARTITION BY entidade, ex, df ORDER BY anoempenho, empenho) = 1))""")
    return ", ".join(parts) + f" SELECT * FROM k{len(CASES)}"


@query(_chain_sql())
def case_chain(spark, sf_dir):
    """Sixteen cases of every entity and cut-off, each the first commitment that meets it and that no case before has taken."""
    return identity.chain(records(spark, sf_dir), GROUP, KEY, {n: F.expr(c) for n, c in CASES.items()})


#: Orders and lines of a second run: other identifiers, one line in some hundred changed, one in some hundred gone.
RENUMBERED, MOVED, DROPPED = "4000000000 - 3 * {}", "l_orderkey % 640 = 33 AND l_linenumber = 2", "l_orderkey % 640 = 65 AND l_linenumber = 1"
RUNS_SQL = f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS dia, round(o_totalprice * 100)::BIGINT AS total FROM orders),
l AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS valor, {MOVED} AS movida, {DROPPED} AS sumida FROM lineitem),
a AS (SELECT o_custkey, o_orderstatus, dia, total, l_linenumber, valor FROM o JOIN l ON l_orderkey = o_orderkey), b AS (SELECT o_custkey, o_orderstatus, dia, total, l_linenumber, valor + movida::INT AS valor FROM o JOIN l ON l_orderkey = o_orderkey WHERE NOT sumida)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pedido"), "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dia"), cents(F.col("o_totalprice")).alias("total"))
    raw = read(spark, sf_dir, "lineitem")
    line = raw.select(F.col("l_orderkey").alias("pedido"), "l_linenumber", cents(F.col("l_extendedprice")).alias("valor"))
    other = lambda df: df.withColumn("pedido", F.expr(RENUMBERED.format("pedido")).cast("long"))
    moved = raw.where(f"NOT ({DROPPED})").select(F.col("l_orderkey").alias("pedido"), "l_linenumber", (cents(F.col("l_extendedprice")) + F.expr(MOVED).cast("int")).alias("valor"))
    return orders, line, other(orders), other(moved)


@query(f"""{RUNS_SQL} SELECT o_custkey, o_orderstatus, dia, total, l_linenumber, valor, lado FROM (SELECT *, 'a' AS lado FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) x""")
def runs_compared(spark, sf_dir):
    """Lines of two runs whose identifiers differ, paired by the content of their orders: what only one of them has."""
    content = ["o_custkey", "o_orderstatus", "dia", "total"]
    a, line_a, b, line_b = _runs(spark, sf_dir)
    pairs = identity.paired(a, b, "pedido", content)
    unlike = table_differences(line_a, identity.renamed(line_b, "pedido", pairs))
    return unlike.join(a, "pedido").select(*content, "l_linenumber", "valor", "lado")


#: Numbers put into texts by rule: right ones, wrong check digits, all alike, longer runs of digits, masked ones and a made example.
_MADE = ["529.982.247-25", "529.982.247-24", "111.111.111-11", "9529.982.247-25", "***982***", "****123****"]
_TEXTS = "CASE {k} % 60 " + " ".join(f"WHEN {i} THEN 'cpf {n};'" for i, n in enumerate(_MADE, 1)) + " WHEN 7 THEN '111.444.777-35 e 529.982.247-25, 529.982.247-20' ELSE '' END"
_DIGIT = "CAST(substr(d, {i}, 1) AS INT)"
_CHECK = lambda n: f"((({' + '.join(f'{n + 2 - i} * {_DIGIT.format(i=i)}' for i in range(1, n + 1))}) * 10) % 11) % 10 = {_DIGIT.format(i=n + 1)}"


@query(f"""WITH t AS (SELECT doc_id AS chave, 'text' AS coluna, coalesce(text, '') || ' ' || {_TEXTS.format(k="doc_id")} AS t FROM documents UNION ALL SELECT doc_id, 'source', coalesce(source, '') || ' ' || {_TEXTS.format(k="(doc_id + 30)")} FROM documents),
f AS (SELECT chave, coluna, unnest(regexp_extract_all(' ' || t, '(?:^|[^0-9.])([0-9.]*[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}}[0-9.]*)', 1)) AS numero, generate_subscripts(regexp_extract_all(' ' || t, '(?:^|[^0-9.])([0-9.]*[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}}[0-9.]*)', 1), 1) AS p FROM t),
g AS (SELECT chave, coluna, numero, row_number() OVER (PARTITION BY chave, coluna ORDER BY p) AS posicao, replace(replace(numero, '.', ''), '-', '') AS d FROM f WHERE regexp_full_match(numero, '[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}}')),
m AS (SELECT chave, coluna, unnest(regexp_extract_all(t, '[*]{{3,4}}[0-9]{{3}}[*]{{3,4}}')) AS numero, generate_subscripts(regexp_extract_all(t, '[*]{{3,4}}[0-9]{{3}}[*]{{3,4}}'), 1) AS posicao FROM t)
SELECT chave, coluna, 'completo' AS tipo, numero, posicao::INT AS posicao FROM g WHERE d <> repeat(d[1], 11) AND {_CHECK(9)} AND {_CHECK(10)} UNION ALL SELECT chave, coluna, 'mascarado', numero, posicao::INT FROM m WHERE numero NOT IN {CPF_EXAMPLES}""")
def personal_data_found(spark, sf_dir):
    """Taxpayers' numbers in all text columns of the documents, with some put in by rule: where they are, and none of the near misses."""
    docs = read(spark, sf_dir, "documents")
    put = lambda c, k: F.concat_ws(" ", F.coalesce(c, F.lit("")), F.expr(_TEXTS.format(k=k)))
    made = docs.select(F.col("doc_id").alias("chave"), put(F.col("text"), "doc_id").alias("text"), put(F.col("source"), "(doc_id + 30)").alias("source"), "n_chars")
    return personal_data_in(made, ["chave"])


#: Nested bodies of two collections: in the second, by rule, a field is gone, one is new, one has another kind, and one is empty at times.
BODY_SQL = """WITH l AS (SELECT l_orderkey, to_json(list({'linha': l_linenumber, 'valor': round(l_extendedprice * 100)::BIGINT, 'situacao': {'marca': l_returnflag, 'estado': l_linestatus}} ORDER BY l_linenumber))::VARCHAR AS itens FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey % 4 AS fonte, o_orderkey % 2 AS vez, CASE WHEN o_orderkey % 4 = 3 THEN '<html>' ELSE '{"pedido":' || o_orderkey || ',"cliente":{"codigo":' || CASE WHEN o_orderkey % 8 = 5 THEN '"' || o_custkey || '"' ELSE o_custkey::VARCHAR END || CASE WHEN o_orderkey % 4 = 1 THEN ',"novo":[true,{"x":null}]' ELSE ',"antigo":"s"' END || '},"itens":' || CASE WHEN o_orderkey % 16 = 1 THEN 'null' ELSE coalesce(itens, '[]') END || '}' END AS corpo
 FROM orders LEFT JOIN l ON l_orderkey = o_orderkey), j AS (SELECT vez, corpo::JSON AS corpo FROM b WHERE fonte <> 3),
t AS (SELECT vez, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS caminho, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS tipo FROM j, json_tree(corpo)),
f AS (SELECT vez, caminho, string_agg(DISTINCT tipo, '|' ORDER BY tipo) AS tipos, list(DISTINCT tipo) AS lista FROM t GROUP BY ALL),
ch AS (SELECT coalesce(a.caminho, b.caminho) AS caminho, a.tipos AS antes, b.tipos AS agora, CASE WHEN a.caminho IS NULL THEN 'novo' WHEN b.caminho IS NULL THEN 'removido' WHEN len(list_filter(b.lista, lambda x: x <> 'null' AND NOT list_contains(a.lista, x))) > 0 THEN 'tipo diferente' END AS mudanca
 FROM (SELECT * FROM f WHERE vez = 0) a FULL JOIN (SELECT * FROM f WHERE vez = 1) b ON a.caminho = b.caminho)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").repartition(tasks(spark, sf_dir), "l_orderkey").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("linha"), cents(F.col("l_extendedprice")).alias("valor"), F.struct(F.col("l_returnflag").alias("marca"), F.col("l_linestatus").alias("estado")).alias("situacao"))))).alias("itens"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(line.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")  # bodies are many times their files' size
    k, text = F.col("o_orderkey"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    client = F.when(k % 8 == 5, text('"', F.col("o_custkey").cast("string"), '"')).otherwise(F.col("o_custkey").cast("string"))
    more = F.when(k % 4 == 1, ',"novo":[true,{"x":null}]').otherwise(',"antigo":"s"')
    items = F.when(k % 16 == 1, "null").otherwise(F.coalesce("itens", F.lit("[]")))
    body = F.when(k % 4 == 3, "<html>").otherwise(text('{"pedido":', k.cast("string"), ',"cliente":{"codigo":', client, more, '},"itens":', items, "}"))
    return orders.select((k % 4).alias("fonte"), (k % 2).alias("vez"), body.alias("corpo"))


@query(f"{BODY_SQL} SELECT caminho, antes, agora, mudanca FROM ch WHERE mudanca IS NOT NULL")
def nested_shape_changes(spark, sf_dir):
    """Paths at any depth that a second collection of nested bodies has gained or lost, or where it has another kind of value."""
    found = cut(shapes.shape(shapes.paths(_bodies(spark, sf_dir), "corpo", ["vez"]), ["vez"]))  # as many rows as there are paths; bodies are walked once
    at = lambda n: found.where(F.col("vez") == n).drop("vez")
    return shapes.changes(at(0), at(1), [])


@query(f"""{BODY_SQL}, s AS (SELECT fonte, count(*) AS corpos, count(*) FILTER (fonte <> 3) AS lidos FROM b GROUP BY fonte), g AS (SELECT fonte, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS caminho, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS tipo
 FROM (SELECT fonte, corpo::JSON AS corpo FROM b WHERE fonte <> 3) q, json_tree(corpo)), h AS (SELECT fonte, caminho, list(DISTINCT tipo) AS lista, string_agg(DISTINCT tipo, '|' ORDER BY tipo) AS tipos FROM g GROUP BY ALL),
z AS (SELECT fonte, sha256(string_agg(caminho || ':' || tipos, chr(10) ORDER BY encode(caminho || ':' || tipos))) AS forma_sha256 FROM h GROUP BY fonte),
p AS (SELECT s.fonte, count(*) AS n FROM s CROSS JOIN (SELECT DISTINCT caminho FROM h) c LEFT JOIN h a ON a.fonte = 0 AND a.caminho = c.caminho LEFT JOIN h b ON b.fonte = s.fonte AND b.caminho = c.caminho
 WHERE s.lidos > 0 AND ((a.caminho IS NULL) <> (b.caminho IS NULL) OR len(list_filter(b.lista, lambda x: x <> 'null' AND NOT list_contains(a.lista, x))) > 0) GROUP BY s.fonte)
SELECT s.fonte::BIGINT AS fonte, s.corpos::BIGINT AS corpos, s.lidos::BIGINT AS lidos, coalesce(p.n, 0)::BIGINT AS mudancas, CASE WHEN s.lidos = 0 THEN 'indisponivel' WHEN coalesce(p.n, 0) > 0 THEN 'mudou' ELSE 'ok' END AS resultado, z.forma_sha256 FROM s LEFT JOIN p ON p.fonte = s.fonte LEFT JOIN z ON z.fonte = s.fonte""")
def contract_probe(spark, sf_dir):
    """What a probe says of four sources, each against the shape of the first: unchanged, changed, or not JSON at all; and the hash of each one's shape."""
    bodies = _bodies(spark, sf_dir)
    found = cut(shapes.shape(shapes.paths(bodies, "corpo", ["fonte"]), ["fonte"]))  # as many rows as there are paths; bodies are walked once
    sources = bodies.select("fonte").distinct()
    reference = found.where("fonte = 0").drop("fonte").crossJoin(sources.join(found.select("fonte").distinct(), "fonte"))  # a contract's paths for each source that was read
    told = shapes.verdict(bodies, "corpo", shapes.changes(reference, found, ["fonte"]), ["fonte"])
    return told.join(shapes.shape_hash(found, ["fonte"]).drop("caminhos"), "fonte", "left")


#: How a statement is printed, by entity and year: one layout after the other, one that no rule knows, one whose total is wrong, one on two pages, one without a period.
HOW = "CASE WHEN entidade = 4 THEN 3 + CAST(ex % 4 AS INT) ELSE CAST((entidade + ex) % 3 AS INT) END"


@query(f"""{STATEMENT_SQL}, h AS (SELECT entidade, ex, df, coluna, valor, {HOW} AS como FROM stm WHERE versao = 'v2' AND coluna NOT IN ('S1', 'S2', 'S3')),
z AS (SELECT entidade, ex, df, como, count(*) FILTER (valor = 0) AS zeros, sum(CASE WHEN coluna = 'L' THEN valor END)::BIGINT AS saldo FROM h GROUP BY ALL)
SELECT entidade, ex, df, CASE WHEN como = 0 THEN 'rp-rreo-coordenadas/2' WHEN como = 1 AND zeros = 0 THEN 'rp-rreo-2016/1' WHEN como = 2 THEN 'rp-rreo-siconfi/1' END AS layout, CASE WHEN como = 0 OR como = 2 OR (como = 1 AND zeros = 0) THEN df END AS fim,
 CASE como WHEN 3 THEN 'colunas não encontradas' WHEN 4 THEN 'TOTAL difere de (I) + (II)' WHEN 5 THEN '2 páginas' WHEN 6 THEN 'período não encontrado' WHEN 1 THEN CASE WHEN zeros > 0 THEN 'linhas não lidas' END END AS motivo,
 CASE WHEN como = 0 OR como = 2 OR (como = 1 AND zeros = 0) THEN 24 ELSE 0 END::BIGINT AS celulas, CASE WHEN como = 0 OR como = 2 OR (como = 1 AND zeros = 0) THEN saldo END AS saldo FROM z""")
def layouts_read(spark, sf_dir):
    """Statements printed in three layouts, read by the first rule that holds, and those that no rule reads, with the reason."""
    rows = cut(statement(spark, sf_dir, ("v2",)).where(~F.col("coluna").isin("S1", "S2", "S3")).withColumn("como", F.expr(HOW)))
    letters = F.array(*[F.lit(c) for c in statements.LETTERS])
    i, how = F.array_position(letters, F.col("coluna")).cast("double"), F.col("como")
    doc = F.concat_ws("|", F.col("entidade").cast("string"), F.col("ex").cast("string"), "df")
    word = lambda x, y, t, page=1: F.struct(F.lit(page).alias("page"), x.alias("x0"), F.lit(y).cast("double").alias("y0"), (x + 8).alias("x1"), F.lit(y + 5.0).alias("y1"), t.alias("text"))
    x = 250 + 50 * i
    chosen = lambda values: F.coalesce(*[F.when(F.col("coluna") == c, v) for c, v in values.items()])
    letter, equal = F.col("coluna"), F.col("coluna").isin("e", "k", "L")
    number = F.when(F.col("valor") == 0, F.when(how == 1, "0,0").otherwise("-")).otherwise(format_cents(F.col("valor")))
    wrong = F.when((how == 4) & F.col("coluna").isin("a", "e", "L"), format_cents(F.col("valor") + 100)).otherwise(number)
    plain, second, pieces = how.isin(0, 4, 5, 6), how == 1, how == 2
    each = F.array_compact(F.array(
        F.when(plain, word(x, 100.0, chosen({v: k for k, v in statements.PAGE_LABELS.items()}))), F.when(second, word(x, 180.0, chosen(dict(zip(statements.LETTERS, statements.HEADS_2016, strict=True))))), F.when(second & F.col("coluna").isin("a", "b"), word(x + 9, 190.0, F.lit("Em"))),
        F.when(pieces, word(x, 100.0, letter)), F.when(pieces & ~equal, word(x - 10, 100.0, F.lit("("))), F.when(pieces, word(x + 10, 100.0, F.when(equal, "=").otherwise(")"))),
        word(x + 1, 210.0, number), word(x + 1, 230.0, wrong),
    ))
    month = F.get(F.array(*[F.lit(m) for m in statements.MONTHS]), F.month(F.to_date("df")) - 1)
    year = F.when(pieces, F.col("ex").cast("string")).otherwise(F.concat(F.col("ex").cast("string").substr(1, 1), F.lit("."), F.col("ex").cast("string").substr(2, 3)))
    say = lambda k, t: word(F.lit(10.0 + 40 * k), 20.0, t)
    title = F.when(how != 6, F.array(say(0, F.lit("JANEIRO")), say(1, F.when(pieces, "À").otherwise("A")), say(2, month), say(3, year), say(4, F.lit("/")), say(5, F.lit("BIMESTRE")))).otherwise(F.array(say(0, F.lit("x"))))
    names = F.array(*[word(F.lit(10.0 + 20 * k), y, F.lit(t)) for y, text in ((210.0, "RESTOS A PAGAR (EXCETO"), (230.0, "TOTAL (III) =")) for k, t in enumerate(text.split())])
    extra = F.when(how == 5, F.array(word(F.lit(10.0), 20.0, F.lit("2"), 2))).otherwise(F.array().cast("array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>"))
    once = rows.select(doc.alias("doc"), "df", "ex", "como").distinct()
    words = rows.select(doc.alias("doc"), F.explode(each).alias("w")).unionByName(once.select("doc", F.explode(F.concat(title, names, extra)).alias("w")))
    told, cells = statements.read_layouts(cut(words.select("doc", "w.*")))
    sums = cells.groupBy("doc").agg(F.count(F.lit(1)).alias("celulas"), F.max(F.when((F.col("linha") == statements.ROW_LABELS[3]) & (F.col("coluna") == "L"), F.col("valor"))).alias("saldo"))
    part = F.split("doc", r"\|")
    return told.join(sums, "doc", "left").select(part[0].cast("long").alias("entidade"), part[1].cast("long").alias("ex"), part[2].alias("df"), "layout", "fim", "motivo", F.coalesce("celulas", F.lit(0)).cast("long").alias("celulas"), "saldo")
