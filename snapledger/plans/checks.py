"""Arrival contracts, statements read from words, integrity, provenance and governance, each with faults planted by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import cents, format_cents
from ..functions.text import private_path, valid_cpf
from ..operators import integrity as integ
from ..operators import variation as var
from ..operators.pairing import excluded_side
from ..sources import contracts, statements, store
from ..sources.ledger import read
from .arrival import PAGE, pages
from .history import INSTANTS, SNAP_SQL, snapshots
from .indicators import STATEMENT_SQL, records, statement
from .registry import RECORDS, query
from .relations import ALL_ANOMALIES_SQL, DECISIONS_SQL, PAIRS_SQL, _pairs, all_anomalies, decisions

# ---------------------------------------------------------------- scalars


@query("""WITH e AS (SELECT event_id, event_id % 4 AS k, date_trunc('second', ts) AS t FROM events)
SELECT event_id, strftime(CASE k WHEN 0 THEN t::DATE + INTERVAL 1 DAY - INTERVAL 1 SECOND + INTERVAL 3 HOUR WHEN 1 THEN t + INTERVAL 3 HOUR WHEN 2 THEN t ELSE t - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS instante, ((month(t) + 1) // 2)::BIGINT AS bimestre, strftime(last_day(make_date(year(t), (((month(t) + 1) // 2) * 2), 1)), '%Y-%m-%d') AS fim, 'janeiro' AS mes FROM e""")
def instants(spark, sf_dir):
    """Instants from dates, times without offset, in UTC and with an offset; the bimester and its end; the month's name."""
    k, t = F.col("event_id") % 4, F.date_trunc("second", "ts")
    at = lambda f: F.date_format(t, f)
    text = F.when(k == 0, at("yyyy-MM-dd")).when(k == 1, at("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(at("yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    day = F.to_date("ts")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(dates.canonical_instant(text), "yyyy-MM-dd HH:mm:ss").alias("instante"), dates.bimester(day).alias("bimestre"), F.date_format(dates.bimester_end(F.year(day), dates.bimester(day)), "yyyy-MM-dd").alias("fim"), dates.month_name(day).alias("mes"))


@query("""WITH t AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS n FROM customer), d AS (SELECT *, [substr(n, i, 1)::INT for i in range(1, 10)] AS d FROM t),
a AS (SELECT *, (list_sum([d[i] * (11 - i) for i in range(1, 10)]) * 10 % 11 % 10)::INT AS x FROM d), b AS (SELECT *, ((list_sum([d[i] * (12 - i) for i in range(1, 10)]) + x * 2) * 10 % 11 % 10)::INT AS y FROM a)
SELECT c_custkey, (c_custkey % 100 = x * 10 + y) AND NOT regexp_full_match(n || lpad((c_custkey % 100)::VARCHAR, 2, '0'), '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+') AS valido, c_custkey % 3 = 0 AS privado FROM b""")
def personal_data(spark, sf_dir):
    """Whether a number has the check digits of a person's, and whether a path is private."""
    k = F.col("c_custkey")
    text = F.concat(F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0"), F.lpad((k % 100).cast("string"), 2, "0"))
    path = F.when(k % 9 == 0, "privado/a.json").when(k % 9 == 3, "dados/privado/a.json").when(k % 9 == 6, "dados/a.private").otherwise("dados/privados.json")
    return read(spark, sf_dir, "customer").select("c_custkey", valid_cpf(text).alias("valido"), private_path(path).alias("privado"))


# ---------------------------------------------------------------- arrival

FAULTS = ["", "não é JSON", "number: tipo", "numberOfElements: incoerente", "totalPages: incoerente", "first: incoerente", "empty: incoerente", "sort: ausente", "size: domínio"]


@query(f"SELECT DISTINCT o_orderkey // {PAGE} AS pagina, nullif(['{"', '".join(FAULTS)}'][(o_orderkey // {PAGE}) % {len(FAULTS)} + 1], '') AS violacao FROM orders")
def page_contract(spark, sf_dir):
    """Pages with one fault each, by number, and the rule that finds it."""
    p = F.col("pagina")
    k = p % len(FAULTS)
    n = F.when(k == 2, '"1"').otherwise("0")
    empty, size = F.when(k == 6, "false").otherwise("true"), F.when(k == 8, "0").otherwise("10")
    body = F.concat(
        F.lit('{"content":[],"number":'), n, F.lit(',"numberOfElements":'), F.when(k == 3, "4").otherwise("0"), F.lit(',"size":'), size, F.lit(',"totalElements":0,"totalPages":'), F.when(k == 4, "2").otherwise("0"),
        F.lit(',"first":'), F.when(k == 5, "false").otherwise("true"), F.lit(',"last":true,"empty":'), empty, F.when(k == 7, "").otherwise(',"sort":[]'), F.lit(',"pageable":{}'), F.when(k == 1, "").otherwise("}"),
    )
    made = read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {PAGE}").alias("pagina")).distinct().withColumn("body", body)
    return contracts.page_violations(made).select("pagina", "violacao")


@query("""WITH p AS (SELECT o_custkey AS coleta, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS numero, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT coleta, max(n)::BIGINT AS paginas, CASE coleta % 5 WHEN 1 THEN CASE WHEN max(n) > 1 THEN 'total mudou entre páginas' END WHEN 2 THEN 'soma difere do total' WHEN 3 THEN 'marca de última página' END AS violacao,
CASE WHEN coleta % 5 IN (0, 4) OR (coleta % 5 = 1 AND max(n) = 1) THEN 'completa' ELSE 'incompleta' END AS status FROM p GROUP BY coleta""")
def paging_check(spark, sf_dir):
    """Collections of pages against themselves: totals, sums and the last page's mark; the faults follow the collection's number."""
    own, all_ = Window.partitionBy("coleta").orderBy("o_orderkey"), Window.partitionBy("coleta")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("coleta"), "o_orderkey").withColumns({"numero": (F.row_number().over(own) - 1).cast("int"), "n": F.count(F.lit(1)).over(all_)})
    k = F.col("coleta") % 5
    total = F.col("n") + F.when(k == 2, 1).when((k == 1) & (F.col("numero") > 0), 1).otherwise(0)
    last = (F.col("numero") == F.col("n") - 1) & (k != 3)
    made = rows.withColumns({"elementos": F.lit(1), "total": total, "ultima": last})
    return contracts.paging(made).select("coleta", "paginas", "violacao", "status")


@query("""WITH r AS (SELECT o_custkey AS coleta, o_orderkey, year(o_orderdate) AS ano, lag(year(o_orderdate)) OVER w AS a0, lag(o_orderkey) OVER w AS k0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT coleta, count(*)::BIGINT AS fora_de_ordem FROM r WHERE ano < a0 OR (ano = a0 AND o_orderkey < k0) GROUP BY coleta""")
def order_check(spark, sf_dir):
    """Records whose order key is below that of the record before, across pages too."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("coleta"), F.expr("o_orderkey div 100").alias("p"), "o_orderkey", F.year("o_orderdate").alias("ano"))
    return contracts.out_of_order(rows, "coleta", "p", "o_orderkey", ["ano", "o_orderkey"]).groupBy("coleta").agg(F.count(F.lit(1)).alias("fora_de_ordem"))


@query("SELECT p_partkey AS pagina, p_name AS primeira, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END AS segunda FROM part WHERE p_partkey % 13 = 0 OR (p_partkey % 7 = 0 AND p_type <> p_name)")
def second_reading(spark, sf_dir):
    """Pages on which a second reading differs or is missing."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pagina"), "p_name", "p_type")
    again = part.where("pagina % 13 <> 0").select("pagina", F.when(F.col("pagina") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("sha256"))
    return contracts.second_read(part.select("pagina", F.col("p_name").alias("sha256")), again, ["pagina"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS vezes, count(DISTINCT l_suppkey % 2) AS paginas, count(DISTINCT l_partkey::VARCHAR || '/' || l_suppkey::VARCHAR) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT l_orderkey % 97 AS coleta, CASE WHEN c = 1 THEN 'exata' ELSE 'conflitante' END AS tipo, count(*)::BIGINT AS chaves, count(*) FILTER (paginas > 1)::BIGINT AS entre_paginas FROM r GROUP BY ALL""")
def repeated_across_pages(spark, sf_dir):
    """Keys that a collection has twice, on one page or on two, alike or not."""
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("coleta"), "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 2).alias("p"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("c"))
    found = contracts.repeated_records(lines, "coleta", ["l_orderkey", "l_linenumber"], "p", F.col("c"))
    return found.groupBy("coleta", "tipo").agg(F.count(F.lit(1)).alias("chaves"), F.count_if(F.col("paginas") > 1).alias("entre_paginas"))


@query("""WITH d AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1), r AS (SELECT l_orderkey // 10 AS coleta, 'CHAVE-DUP' AS motivo FROM d UNION ALL SELECT o_orderkey // 10, 'VALOR-RECUSADO' FROM orders WHERE o_orderkey % 11 < 2)
SELECT coleta, min(motivo) AS motivo, count(*)::BIGINT AS ocorrencias FROM r GROUP BY coleta""")
def refused_collections(spark, sf_dir):
    """Collections that never count, and why; a repeated key comes before a refused value."""
    repeated = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.expr("l_orderkey div 10").alias("coleta"), F.lit("CHAVE-DUP").alias("m"))
    refused = read(spark, sf_dir, "orders").where("o_orderkey % 11 < 2").select(F.expr("o_orderkey div 10").alias("coleta"), F.lit("VALOR-RECUSADO").alias("m"))
    return contracts.refused_collections(repeated.unionByName(refused), "coleta", "m")


@query("SELECT o_custkey AS coleta, count(*)::BIGINT AS paginas, count(*) FILTER (o_orderstatus <> 'P')::BIGINT AS boas, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = count(*) THEN 'completa' WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'falhou' ELSE 'incompleta' END AS status FROM orders GROUP BY o_custkey")
def imported_status(spark, sf_dir):
    """The status of historic collections from that of their pages."""
    return contracts.collection_status(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "coleta"), "coleta", F.col("o_orderstatus") != "P")


@query("""SELECT n_nationkey::BIGINT AS entidade, (1996 + n_nationkey % 5)::BIGINT AS ex, n_nationkey % 2 = 0 AS aberto, CASE n_nationkey % 6 WHEN 1 THEN NULL ELSE n_nationkey % 3 = 0 END AS fechado, CASE n_nationkey % 6 WHEN 1 THEN '$.fechado: absent' WHEN 2 THEN '$.aberto: STRING' END AS violacao FROM nation WHERE n_nationkey % 6 <> 2
UNION ALL SELECT n_nationkey, 1996 + n_nationkey % 5, NULL, n_nationkey % 3 = 0, '$.aberto: STRING' FROM nation WHERE n_nationkey % 6 = 2""")
def catalog_contract(spark, sf_dir):
    """A catalog of fiscal years as nested JSON lists: its rows, and what is absent or of another type."""
    n = F.col("n_nationkey")
    flag = lambda c: F.when(c, "true").otherwise("false")
    item = F.concat(F.lit('{"id":{"entidade":{"id":'), n.cast("string"), F.lit('},"exercicio":'), (1996 + n % 5).cast("string"), F.lit('},"aberto":'), F.when(n % 6 == 2, '"x"').otherwise(flag(n % 2 == 0)), F.when(n % 6 == 1, "").otherwise(F.concat(F.lit(',"fechado":'), flag(n % 3 == 0))), F.lit("}"))
    bodies = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), item, F.lit("]")).alias("body"))
    found = contracts.catalog_violations(contracts.list_items(bodies, ["n_nationkey"]), "exercicios")
    return contracts.catalog_years(found.select("item")).join(found.select(F.try_variant_get("item", "$.id.entidade.id", "bigint").alias("entidade"), "violacao"), "entidade")


@query(f"SELECT s_nationkey::BIGINT AS entidade, count(*)::BIGINT AS coletas FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY ALL")
def outside_catalog(spark, sf_dir):
    """Collections of entities that the latest catalog doesn't have."""
    known = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("entidade"))
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("entidade")).join(known, "entidade", "left_anti").groupBy("entidade").agg(F.count(F.lit(1)).alias("coletas"))


@query("""SELECT '$.k' AS caminho, 'tipo mudou' AS mudanca, 'BIGINT' AS antes, 'BIGINT,STRING' AS agora UNION ALL SELECT '$.novo', 'novo', NULL, 'BOOLEAN'""")
def shape_drift(spark, sf_dir):
    """What a sample's JSON has that the reference's hasn't: a new path and another type."""
    events = read(spark, sf_dir, "events").select("event_id", "props")
    changed = F.when(F.col("event_id") % 50 == 0, '{"k": "x", "novo": true}').otherwise(F.col("props"))
    return contracts.shape_changes(contracts.path_types(events, "props"), contracts.path_types(events.select(changed.alias("props")), "props"))


# ---------------------------------------------------------------- statements


@query(f"{STATEMENT_SQL} SELECT entidade, ex, df, coluna, valor FROM stm WHERE versao = 'v2' AND coluna NOT IN ('S1', 'S2', 'S3') AND (entidade + ex) % 7 <> 0")
def words_read(spark, sf_dir):
    """Statements printed as positioned words and read back; a document that lacks a number is left out whole."""
    rows = statement(spark, sf_dir, ("v2",)).where(~F.col("coluna").isin("S1", "S2", "S3")).withColumn("i", F.array_position(F.array(*[F.lit(c) for c in statements.LETTERS]), F.col("coluna")).cast("double"))
    doc = F.concat_ws("|", F.col("entidade").cast("string"), F.col("ex").cast("string"), "df")
    word = lambda x0, y0, t: F.struct(F.lit(1).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 5).alias("y1"), t.alias("text"))
    heads = {v: k for k, v in statements.PAGE_LABELS.items()}
    label = F.coalesce(*[F.when(F.col("coluna") == c, t) for c, t in heads.items()])
    x = 250 + 50 * F.col("i")
    number = F.when(F.col("valor") == 0, "-").otherwise(format_cents(F.col("valor")))
    gone = ((F.col("entidade") + F.col("ex")) % 7 == 0) & (F.col("coluna") == "c")
    cells = rows.select(doc.alias("doc"), F.explode(F.array_compact(F.array(word(x, F.lit(100.0), label), F.when(~gone, word(x - 3, F.lit(121.0) + F.col("i") / 6, number))))).alias("w"))
    names = rows.select(doc.alias("doc")).distinct().select("doc", F.explode(F.array(word(F.lit(10.0), F.lit(120.5), F.lit("TOTAL")), word(F.lit(40.0), F.lit(121.5), F.lit("(III)")), word(F.lit(70.0), F.lit(121.0), F.lit("=")))).alias("w"))
    found = statements.cells(cells.unionByName(names).select("doc", "w.*"))
    part = F.split("doc", r"\|")
    return found.select(part[0].cast("long").alias("entidade"), part[1].cast("long").alias("ex"), part[2].alias("df"), "coluna", "valor")


@query(f"""{STATEMENT_SQL}, pt AS (SELECT DISTINCT entidade, ex, df FROM stm) SELECT entidade, ex, df, CASE (entidade + ex) % 5 WHEN 0 THEN 'sem TOTAL' WHEN 1 THEN 'sem linha (I)' WHEN 2 THEN 'identidade' WHEN 3 THEN 'TOTAL difere de (I) + (II)' END AS violacao FROM pt""")
def statement_validated(spark, sf_dir):
    """Statements with one fault each, by number, and the rule that refuses them."""
    rows = statement(spark, sf_dir, ("v2",)).where(~F.col("coluna").isin("S1", "S2", "S3"))
    k = (F.col("entidade") + F.col("ex")) % 5
    first, total = statements.ROW_LABELS[0], statements.ROW_LABELS[3]
    one = rows.where(k != 1).withColumn("linha", F.lit(first)).withColumn("valor", F.col("valor") + F.when((k == 3) & F.col("coluna").isin("a", "e", "L"), 5).otherwise(0))
    whole = rows.where(k != 0).withColumn("linha", F.lit(total)).withColumn("valor", F.col("valor") + F.when((k == 2) & (F.col("coluna") == "a"), 1).otherwise(0))
    return statements.validate(one.unionByName(whole), ["entidade", "ex", "df"])


@query(f"{STATEMENT_SQL}, pt AS (SELECT DISTINCT entidade, ex, df FROM stm WHERE versao = 'v2') SELECT entidade, ex, df, entidade % 2 = 0 AS zero FROM pt")
def legislative_omitted(spark, sf_dir):
    """The legislative row that a declaration omits is zero only where (I) is the executive's."""
    rows = statements.wide(statement(spark, sf_dir, ("v2",)).where(~F.col("coluna").isin("S1", "S2", "S3")), ["entidade", "ex", "df"])
    executive = rows.withColumn("linha", F.lit(statements.ROW_LABELS[1])).withColumn("a", F.col("a") + F.col("entidade") % 2)
    table = rows.withColumn("linha", F.lit(statements.ROW_LABELS[0])).unionByName(executive)
    found = statements.legislative_row(table, ["entidade", "ex", "df"])
    return found.groupBy("entidade", "ex", "df").agg(F.bool_or(F.col("linha") == statements.LEGISLATIVE).alias("zero"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'homologada' WHEN 1 THEN 'retificada' ELSE 'XX' END AS situacao FROM supplier WHERE s_suppkey % 4 < 2 AND s_suppkey % 6 = 2")
def delivery_status(spark, sf_dir):
    """The state of the bimestral report's delivery for a period."""
    k = F.col("s_suppkey")
    items = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 4 < 2, "Relatório Resumido de Execução").otherwise("Balanço").alias("entregavel"), F.lit("B").alias("periodicidade"), (k % 6).alias("periodo"), F.when(k % 3 == 0, "HO").when(k % 3 == 1, "RE").otherwise("XX").alias("status_relatorio"))
    return statements.deliveries(items, F.lit(2)).select("s_suppkey", "situacao")


# ---------------------------------------------------------------- integrity and governance


@query("SELECT 0::BIGINT AS recusados_com_registro, (SELECT count(*) FROM orders WHERE o_orderkey % 11 < 5)::BIGINT AS recusados, (SELECT count(*) FROM orders WHERE o_orderkey % 11 > 4)::BIGINT AS registros")
def exclusivity(spark, sf_dir):
    """A refused record is never stored: none is in both, and together they are all."""
    items = contracts.items(pages(spark, sf_dir), ["pagina"])
    side = lambda df, bad: df.select("pagina", "indice", F.lit(bad).alias("bad"))
    both = side(contracts.refused_values(items, ["pagina"]), True).unionByName(side(contracts.records(items, ["pagina"]), False))
    # every page is read once by either side; an item's marks meet in one row
    each = both.groupBy("pagina", "indice").agg(F.max("bad").alias("r"), F.count_if(~F.col("bad")).alias("n"))
    return each.agg(F.count_if(F.col("r") & (F.col("n") > 0)).alias("recusados_com_registro"), F.count_if("r").alias("recusados"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("registros"))


@query("""SELECT 'linha sem pedido' AS elo, count(*)::BIGINT AS quebras FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'pedido sem linha', count(*)::BIGINT FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'pedido sem cliente', count(*)::BIGINT FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey) UNION ALL SELECT 'cliente sem pedido', count(*)::BIGINT FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'contagem difere', count(*)::BIGINT FROM (SELECT l_orderkey, count(*) n, count(DISTINCT l_linenumber) m FROM lineitem GROUP BY ALL) WHERE n <> m""")
def provenance_bulk(spark, sf_dir):
    """How many links of each kind are broken."""
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}
    anti = lambda a, k, b, q: t[a].select(k).join(t[b].select(q), F.col(k) == F.col(q), "left_anti")
    counted = t["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("m")).where("n <> m")
    return integ.broken_links({"linha sem pedido": anti("lineitem", "l_orderkey", "orders", "o_orderkey"), "pedido sem linha": anti("orders", "o_orderkey", "lineitem", "l_orderkey"), "pedido sem cliente": anti("orders", "o_custkey", "customer", "c_custkey"), "cliente sem pedido": anti("customer", "c_custkey", "orders", "o_custkey"), "contagem difere": counted})


@query("SELECT doc_id, sha256(text) AS sha256, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS integro FROM documents")
def provenance_chain(spark, sf_dir):
    """Each record traced to its response and stored object: broken where the object is missing (5) or not what its name says (7)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.encode("text", "UTF-8").alias("bytes"))
    rec = docs.select(F.col("doc_id").alias("coleta"), F.lit(1).alias("ordem"), "doc_id")
    named = F.concat("sha256", F.lit("/"), F.col("doc_id").cast("string"))
    responses = docs.select(F.col("doc_id").alias("coleta"), F.lit(1).alias("ordem"), F.col("sha256").alias("h"), named.alias("nome"), F.octet_length("bytes").alias("tamanho"))
    objects = docs.where("doc_id % 5 <> 0").select(named.alias("nome"), F.when(F.col("doc_id") % 7 == 0, F.concat("bytes", F.lit(b"!"))).otherwise(F.col("bytes")).alias("body"))
    found = integ.provenance(rec, responses.withColumnRenamed("nome", "sha256"), objects.withColumnRenamed("nome", "sha256"), expected="h")
    return found.select("doc_id", F.col("h").alias("sha256"), "integro")


@query("""SELECT p_partkey AS codigo, CASE WHEN p_partkey % 10 = 0 THEN 'só no código' WHEN p_partkey % 10 = 1 THEN 'só no banco' ELSE 'difere' END AS onde FROM part WHERE p_partkey % 10 < 3""")
def catalog_divergence(spark, sf_dir):
    """Rules whose fingerprints differ between the code's catalog and the stored one."""
    part, k = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "codigo"), F.col("codigo") % 10
    stored = part.where(k != 0).withColumn("p_type", F.when(k == 2, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")))
    return integ.catalog_differences(part.where(k != 1), stored, ["codigo"], ["p_name", "p_type", "p_size"])


@query(f"""{DECISIONS_SQL}, d AS (SELECT uid, situacao, compoe, CASE WHEN uid % 7 <> 0 THEN 'doc' END AS fonte, CASE WHEN uid % 5 <> 0 THEN 'tests/t.py::t' END AS teste, CASE WHEN uid % 3 = 0 THEN uid END AS evidencia, CASE WHEN uid % 11 = 0 THEN 'x' END AS ressalva FROM dec)
SELECT v, count(*)::BIGINT AS decisoes FROM (SELECT CASE WHEN compoe AND situacao <> 'operacional' THEN 'só regra operacional compõe' WHEN ressalva IS NOT NULL AND situacao <> 'operacional' THEN 'ressalva só na promoção' WHEN situacao = 'operacional' AND fonte IS NULL THEN 'sem fonte'
 WHEN situacao = 'operacional' AND teste IS NULL THEN 'sem teste de regressão' WHEN situacao = 'operacional' AND compoe AND evidencia IS NULL AND ressalva IS NULL THEN 'sem evidência nem ressalva' END AS v FROM d) GROUP BY v""")
def promotion_criteria(spark, sf_dir):
    """Decisions by the criterion that they break."""
    u = F.col("uid")
    d = decisions(spark, sf_dir).withColumns({"fonte": F.when(u % 7 != 0, "doc"), "teste": F.when(u % 5 != 0, "tests/t.py::t"), "evidencia": F.when(u % 3 == 0, u), "ressalva": F.when(u % 11 == 0, "x")})
    return d.groupBy(integ.decision_violation().alias("v")).agg(F.count(F.lit(1)).alias("decisoes"))


@query(f"{DECISIONS_SQL}, c AS (SELECT regra, arg_max(situacao, ts) AS s, arg_max(compoe, ts) AS c, list(situacao ORDER BY ts) AS h FROM dec GROUP BY regra) SELECT regra, NOT (s = 'operacional' AND c) AS bloqueada, array_to_string(h[-3:], '>') AS ultimas FROM c")
def published_guard(spark, sf_dir):
    """Rules that may not be published now, with their last three decisions."""
    d = decisions(spark, sf_dir)
    now = integ.decisions_as_of(d, "regra", "ts", "uid", ["situacao", "compoe"])
    last = d.withColumn("n", F.row_number().over(Window.partitionBy("regra").orderBy(F.desc("ts"), F.desc("uid")))).where("n <= 3")
    tail = last.groupBy("regra").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "situacao"))), lambda x: x["situacao"]), ">").alias("ultimas"))
    return now.join(tail, "regra").select("regra", (~((F.col("situacao") == "operacional") & F.col("compoe"))).alias("bloqueada"), "ultimas")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), o AS (SELECT o_orderkey AS k, o_custkey % 8 AS setor, o_orderpriority AS tipo, o_totalprice FROM orders),
g AS (SELECT setor, count(*) FILTER (setor = 1 AND k NOT IN (SELECT k FROM l) OR o_totalprice < 0) AS ruins FROM o GROUP BY setor),
p AS (SELECT setor, count(*) AS n, string_agg(DISTINCT tipo, ',' ORDER BY tipo) AS tipos FROM o WHERE setor IN (3, 4) AND k % 1000 = 1 GROUP BY setor),
d AS (SELECT setor, count(*) AS n, count(*) FILTER (setor NOT IN (4, 5, 6) OR k % 500 <> 3) AS c FROM o GROUP BY setor)
SELECT g.setor::BIGINT AS setor, CASE WHEN ruins > 0 THEN 'reprovada' WHEN g.setor = 2 THEN 'incompleta' WHEN coalesce(p.n, 0) > 0 OR c < d.n THEN 'aprovada_com_ressalvas' ELSE 'aprovada_sem_ressalvas' END AS resultado, ruins = 0 AND g.setor <> 2 AS tecnica,
 (ruins > 0)::BIGINT AS reprovados, (g.setor = 2)::BIGINT AS nao_executados, c = d.n AS cobertura_completa, d.n::BIGINT AS documentos, c::BIGINT AS conferidos, coalesce(p.n, 0)::BIGINT AS pendencias, coalesce(tipos, '') AS tipos FROM g JOIN d ON d.setor = g.setor LEFT JOIN p ON p.setor = g.setor""")
def homologation(spark, sf_dir):
    """The verdict of eight sectors: gates that hold, fail, or weren't run (mandatory or not), matters that are pending, documents that weren't checked."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("linhas")).distinct()
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).cast("long").alias("setor"), F.col("o_orderpriority").alias("tipo"), "o_totalprice").join(lines, "o_orderkey", "left")
    s, k = F.col("setor"), F.col("o_orderkey")
    bad = ((s == 1) & F.col("linhas").isNull()) | (F.col("o_totalprice") < 0)
    gates = o.groupBy("setor").agg((F.count_if(bad) == 0).alias("ok")).select("setor", F.lit("itens").alias("portao"), "ok", F.lit(True).alias("obrigatorio"))
    unrun = o.select("setor").distinct().select("setor", F.lit("telas").alias("portao"), F.lit(None).cast("boolean").alias("ok"), (s == 2).alias("obrigatorio"))
    pending = o.where(s.isin(3, 4) & (k % 1000 == 1)).select("setor", "tipo")
    documents = o.select("setor", (~s.isin(4, 5, 6) | (k % 500 != 3)).alias("conferido"))
    return integ.homologation(gates.unionByName(unrun), pending, documents, "setor")


@query(f"{SNAP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY uid DESC) AS k FROM snap) SELECT user_id, event_type, count(*)::BIGINT AS apagaveis, max(uid) AS mais_novo FROM r WHERE k > 2 GROUP BY ALL")
def retention_plan(spark, sf_dir):
    """Runs that would go if the newest two of each group stay."""
    return integ.keep_latest(snapshots(spark, sf_dir), ["user_id", "event_type"], "uid", 2).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("apagaveis"), F.max("uid").alias("mais_novo"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_partkey % 17 = 0 THEN 'a' ELSE 'b' END AS lado FROM lineitem WHERE l_partkey % 17 = 0 OR l_partkey % 19 = 0 AND l_partkey % 17 <> 0")
def tables_compared(spark, sf_dir):
    """Rows that one of two tables has and the other hasn't, repeats counted."""
    line, p = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey"), F.col("l_partkey")
    found = integ.table_differences(line.where(~((p % 19 == 0) & (p % 17 != 0))), line.where(p % 17 != 0))
    return found.select("l_orderkey", "l_linenumber", "lado")


@query("SELECT c_custkey AS chave FROM customer WHERE c_custkey % 23 = 0")
def only_adds(spark, sf_dir):
    """What a later table lost of an earlier one; nothing would prove that it only adds."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chave"))
    return integ.only_adds(c, c.where("chave % 23 <> 0"), ["chave"])


@query("SELECT p_partkey::VARCHAR AS sha256, CASE WHEN p_partkey % 5 = 0 THEN 'banco' ELSE 'acervo' END AS falta_em FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 AND p_partkey % 5 <> 0")
def store_coverage(spark, sf_dir):
    """What the store has and the database hasn't, and the other way."""
    p, k = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sha256"), "p_partkey"), F.col("p_partkey")
    return store.coverage_of(p.where(~((k % 7 == 0) & (k % 5 != 0))), p.where(k % 5 != 0))


@query("SELECT sha256(text) AS sha256, min(octet_length(encode(text)))::BIGINT AS tamanho FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def objects_to_store(spark, sf_dir):
    """Bodies that the store hasn't, once each, under their hash."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return store.new_objects(docs.select("body"), docs.where("doc_id % 3 = 0").select(F.sha2("body", 256).alias("sha256"))).select("sha256", "tamanho")


# ---------------------------------------------------------------- anomalies, quality, audit

RULE_OF = {"CHAVE-DUP": "ANOM-REG v1", "VALOR-RECUSADO": "VALOR-OBRIG v1", "DESCONTINUIDADE": "ANOM-CONT v1", "SALDO-SEM-CONTINUIDADE": "ANOM-CONT v1", "COPIA-SEM-PAR": "PAR-24 v1", "PAR-INSCRICAO-DIVERGENTE": "PAR-24 v1", "PAR-EXECUCAO-DOIS-LADOS": "PAR-24 v1"}


@query(f"{ALL_ANOMALIES_SQL} SELECT entidade, ex, df, anoempenho, empenho, tipo, CASE tipo {' '.join(f"WHEN '{t}' THEN '{r}'" for t, r in RULE_OF.items())} ELSE 'ANOM-REG v1' END AS regra FROM qt WHERE tipo <> 'CHAVE-DUP' AND entidade = 0 ORDER BY tipo, ex NULLS LAST, df NULLS LAST, anoempenho, empenho LIMIT 100 OFFSET 50")
def anomaly_page(spark, sf_dir):
    """A page of an entity's anomalies with the rule that found each."""
    rules = spark.createDataFrame(list(RULE_OF.items()), "tipo string, regra string")
    rows = all_anomalies(spark, sf_dir).where("tipo <> 'CHAVE-DUP' and entidade = 0")
    page = rows.orderBy("tipo", F.col("ex").asc_nulls_last(), F.col("df").asc_nulls_last(), "anoempenho", "empenho").offset(50).limit(100)
    return page.join(rules, "tipo", "left").withColumn("regra", F.coalesce("regra", F.lit("ANOM-REG v1")))


@query("""SELECT 'completude' AS dimensao, count(o_clerk)::BIGINT AS atendem, count(*)::BIGINT AS total FROM (SELECT CASE WHEN o_orderkey % 11 > 0 THEN 1 END AS o_clerk FROM orders) UNION ALL SELECT 'unicidade', count(*) FILTER (n = 1)::BIGINT, count(*)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'consistência', count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))::BIGINT, count(*)::BIGINT FROM orders UNION ALL SELECT 'exatidão', count(*) FILTER (abs(l_extendedprice * 100 - round(l_extendedprice * 100)) < 0.001)::BIGINT, count(*)::BIGINT FROM lineitem
UNION ALL SELECT 'atualidade', count(*) FILTER (ts >= TIMESTAMP '2024-01-20')::BIGINT, count(*)::BIGINT FROM events""")
def quality_dimensions(spark, sf_dir):
    """Dimensions of quality as two whole numbers each; no ratio is rounded."""
    line, orders, events = (read(spark, sf_dir, n) for n in ("lineitem", "orders", "events"))
    of = lambda df, name, good: df.agg(F.count_if(good).alias("atendem"), F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("dimensao"), "atendem", "total")
    price = F.col("l_extendedprice") * 100
    with_lines = orders.join(line.select("l_orderkey").distinct().withColumn("__l", F.lit(1)), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return integ.union_all([
        of(orders, "completude", F.col("o_orderkey") % 11 > 0), of(line.groupBy("l_orderkey", "l_linenumber").count(), "unicidade", F.col("count") == 1), of(with_lines, "consistência", F.col("__l").isNotNull()),
        of(line, "exatidão", F.abs(price - F.round(price)) < 0.001), of(events, "atualidade", F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp")),
    ])


@query(f"{RECORDS} SELECT anoempenho, length(empenho::VARCHAR)::BIGINT AS digitos, count(DISTINCT empenho)::BIGINT AS empenhos FROM rec GROUP BY ALL")
def code_lengths(spark, sf_dir):
    """Lengths of the commitments' numbers by year."""
    return records(spark, sf_dir).groupBy("anoempenho", F.length(F.col("empenho").cast("string")).cast("long").alias("digitos")).agg(F.count_distinct("empenho").alias("empenhos"))


@query(f"""{RECORDS}, c AS (SELECT entidade, anoempenho, empenho, df AS quando, 'valor' AS tipo, s1 AS v FROM rec WHERE entidade = 1 AND empenho % 50 = 7 UNION ALL SELECT n_regionkey, year(o_orderdate), o_orderkey, strftime(l_shipdate, '%Y-%m-%d'), 'lançamento', round(l_extendedprice * 100)::BIGINT FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND o_orderkey % 50 = 7)
SELECT entidade::BIGINT AS entidade, anoempenho::BIGINT AS anoempenho, empenho, quando, tipo, sum(v)::BIGINT AS valor FROM c GROUP BY ALL""")
def chronology(spark, sf_dir):
    """Movements of the commitments of one series beside their values at each cut-off, by day."""
    facts = records(spark, sf_dir).where("entidade = 1 and empenho % 50 = 7").select("entidade", "anoempenho", "empenho", F.col("df").alias("quando"), F.lit("valor").alias("tipo"), F.col("s1").alias("v"))
    nation = read(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    mine = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    orders = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 7").join(mine, "o_custkey", "left_semi").select("o_orderkey", F.year("o_orderdate").cast("long").alias("anoempenho"))
    moves = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit(1).cast("long").alias("entidade"), "anoempenho", F.col("o_orderkey").alias("empenho"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("quando"), F.lit("lançamento").alias("tipo"), cents(F.col("l_extendedprice")).alias("v"))
    return facts.unionByName(moves).groupBy("entidade", "anoempenho", "empenho", "quando", "tipo").agg(F.sum("v").cast("long").alias("valor"))


@query(f"""{SNAP_SQL}, a AS (SELECT user_id, arg_max(uid, ts) AS u, arg_max(valor, ts) AS v FROM snap WHERE NOT bad AND ts <= TIMESTAMP '{INSTANTS[1]}' GROUP BY user_id), b AS (SELECT user_id, arg_max(uid, ts) AS u, arg_max(valor, ts) AS v FROM snap WHERE NOT bad GROUP BY user_id)
SELECT user_id, a.u AS antes, b.u AS depois, (b.v - a.v)::BIGINT AS diferenca FROM a FULL JOIN b USING (user_id) WHERE a.u IS DISTINCT FROM b.u""")
def added_since(spark, sf_dir):
    """What new collections changed since an instant: the snapshot that counted then and the one that counts now."""
    good = snapshots(spark, sf_dir).where(~F.col("bad"))
    best = lambda df, u, v: df.groupBy("user_id").agg(F.max_by(F.struct("uid", "valor"), F.struct("ts", "uid")).alias("b")).select("user_id", F.col("b.uid").alias(u), F.col("b.valor").alias(v))
    then = best(good.where(F.col("ts") <= F.lit(INSTANTS[1]).cast("timestamp")), "antes", "v0")
    both = then.join(best(good, "depois", "v1"), "user_id", "full")
    return both.where(~F.col("antes").eqNullSafe(F.col("depois"))).select("user_id", "antes", "depois", (F.col("v1") - F.col("v0")).alias("diferenca"))


@query(f"""{PAIRS_SQL}, m AS (SELECT ex, df, sum(proc + aproc)::BIGINT AS publicado FROM rec GROUP BY ALL), f AS (SELECT *, CASE WHEN lado <> 'ambos' AND relacao = 'igual' THEN b_proc + b_aproc ELSE 0 END AS v1, CASE WHEN lado <> 'ambos' AND relacao IN ('igual', 'a_e_saldo_final_de_b') THEN a_proc + a_aproc ELSE 0 END AS v2, CASE WHEN relacao = 'igual' AND lado IN ('A', 'nenhum') THEN b_proc + b_aproc ELSE 0 END AS v4 FROM pr)
SELECT m.ex, m.df, any_value(publicado) AS publicado, (any_value(publicado) - coalesce(sum(v1), 0))::BIGINT AS v1, (any_value(publicado) - coalesce(sum(v2), 0))::BIGINT AS v2, (any_value(publicado) - coalesce(sum(v4), 0))::BIGINT AS v4 FROM m LEFT JOIN f ON f.ex = m.ex AND f.df = m.df GROUP BY m.ex, m.df""")
def pair_effects(spark, sf_dir):
    """The inscription published and after each consolidation of pairs."""
    p = _pairs(spark, sf_dir)
    gone = lambda v: F.when(excluded_side(v) == "a", F.col("a_proc") + F.col("a_aproc")).when(excluded_side(v) == "b", F.col("b_proc") + F.col("b_aproc")).otherwise(0)
    less = p.groupBy("ex", "df").agg(*[F.sum(gone(v)).alias(v) for v in ("v1", "v2", "v4")])
    whole = records(spark, sf_dir).groupBy("ex", "df").agg(F.sum(F.col("proc") + F.col("aproc")).cast("long").alias("publicado"))
    return whole.join(less, ["ex", "df"], "left").select("ex", "df", "publicado", *[(F.col("publicado") - F.coalesce(v, F.lit(0))).cast("long").alias(v) for v in ("v1", "v2", "v4")])


@query(f"""{RECORDS}, a AS (SELECT ex, df, count(*) AS registros, sum(proc + aproc) AS inscricao, sum(s1) AS s1 FROM rec WHERE entidade <> 4 GROUP BY ALL), b AS (SELECT ex, df, count(*) AS registros, sum(proc + aproc) AS inscricao, sum(s1) AS s1 FROM rec WHERE ex >= 1997 GROUP BY ALL)
SELECT coalesce(a.ex, b.ex)::BIGINT AS ex, coalesce(a.df, b.df) AS df, CASE WHEN a.ex IS NULL THEN 'novo' WHEN b.ex IS NULL THEN 'removido' ELSE 'alterado' END AS tipo, (coalesce(b.registros, 0) - coalesce(a.registros, 0))::BIGINT AS registros, (coalesce(b.inscricao, 0) - coalesce(a.inscricao, 0))::BIGINT AS inscricao, (coalesce(b.s1, 0) - coalesce(a.s1, 0))::BIGINT AS s1
FROM a FULL JOIN b ON a.ex = b.ex AND a.df = b.df""")
def decision_impact(spark, sf_dir):
    """Indicators before and after a decision on the scope."""
    rec, names = records(spark, sf_dir), ["registros", "inscricao", "s1"]
    sums = lambda df: df.groupBy("ex", "df").agg(F.count(F.lit(1)).alias("registros"), F.sum(F.col("proc") + F.col("aproc")).alias("inscricao"), F.sum("s1").alias("s1"))
    a = sums(rec.where("entidade <> 4")).select("ex", "df", F.lit(True).alias("__a"), *[F.col(n).alias(f"a_{n}") for n in names])
    both = a.join(sums(rec.where("ex >= 1997")).withColumn("__b", F.lit(True)), ["ex", "df"], "full")
    kind = F.when(F.col("__a").isNull(), "novo").when(F.col("__b").isNull(), "removido").otherwise("alterado")
    return both.select("ex", "df", kind.alias("tipo"), *[(F.coalesce(n, F.lit(0)) - F.coalesce(f"a_{n}", F.lit(0))).cast("long").alias(n) for n in names])


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_partkey % 37 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_partkey % 41 <> 0)
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'falta' WHEN a.l_quantity <> b.q THEN 'difere' ELSE 'igual' END AS resultado, count(*)::BIGINT AS registros FROM lineitem a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY 1""")
def source_check(spark, sf_dir):
    """The source's own records against the stored ones, by position."""
    key, line = ["l_orderkey", "l_partkey", "l_suppkey"], read(spark, sf_dir, "lineitem")
    raw = line.select(*key, F.col("l_quantity").cast("long").alias("q"))
    stored = raw.where("l_partkey % 41 <> 0").withColumn("q", F.when(F.col("l_partkey") % 37 == 0, F.col("q") + 1).otherwise(F.col("q")))
    found = var.contributions(raw, stored, key, "q")
    kind = F.when(F.col("depois").isNull(), "falta").when(F.col("antes") != F.col("depois"), "difere").otherwise("igual")
    return found.groupBy(kind.alias("resultado")).agg(F.count(F.lit(1)).alias("registros"))
