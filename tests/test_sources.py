"""Arrival contracts, statements, the object store, and the stream."""

import hashlib
import json

from pyspark.sql import functions as F

from snapledger.sources import contracts, statements, store
from snapledger.streaming import manifests


def test_refusals(spark):
    rows = [("1.10", 110, None), ('"1"', None, "invalido"), ("null", None, "nulo"), (None, None, "ausente"), ("1.234", None, "invalido"), ("true", None, "invalido"), ("7", 700, None), ("0", 0, None), ("-0.5", -50, None)]
    df = spark.createDataFrame([(i, "{" + (f'"proc":{t}' if t else "") + "}") for i, (t, _, _) in enumerate(rows)], "i int, j string").select("i", F.try_parse_json("j").alias("item"))
    out = df.select("i", contracts.money(F.col("item"), "proc").alias("c"), contracts.refusal(F.col("item"), "proc").alias("r")).orderBy("i").collect()
    assert [(r.c, r.r) for r in out] == [(c, r) for _, c, r in rows]


def page(**x):
    return json.dumps(dict(content=[], number=0, numberOfElements=0, size=10, totalElements=0, totalPages=0, first=True, last=True, empty=True, sort=[], pageable={}) | x)


def test_page_contract(spark):
    cases = [(page(), None), ("x", "não é JSON"), (page(number="0"), "number: tipo"), (page(numberOfElements=1), "numberOfElements: incoerente"), (page(totalElements=11, totalPages=1), "totalPages: incoerente"), (page(first=False), "first: incoerente"), (page(empty=False), "empty: incoerente"), ('{"a":1}', "content: ausente")]
    out = contracts.page_violations(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string")).orderBy("i").collect()
    assert [r.violacao for r in out] == [v for _, v in cases]


def test_record_contract(spark):
    good = {f: 1 for f in contracts.INT_FIELDS} | {f: "x" for f in contracts.TEXT_FIELDS} | {f: 1.5 for f in contracts.MONEY_FIELDS}
    cases = [good, good | {"novo": 1}, {k: v for k, v in good.items() if k != "proc"}, good | {"orgao": "1"}, good | {f: "1" for f in contracts.GROUP_FIELDS}, good | {"empenho": "7", "cnpj": None}, good | {"proc": True}]
    df = contracts.items(spark.createDataFrame([(1, page(content=cases))], "p int, body string"), ["p"])
    assert {r.indice: r.violacao for r in contracts.record_violations(df, ["p"]).collect()} == {1: "chave desconhecida: novo", 2: "chave ausente: proc", 3: "grupo incompleto", 5: "tipo: cnpj,empenho", 6: "tipo: proc"}
    kept = contracts.records(df, ["p"]).collect()
    assert sorted(r.indice for r in kept) == [0, 1, 3, 4, 5] and kept[0].proc_c == 150
    assert [(r.indice, r.campo, r.motivo) for r in contracts.refused_values(df, ["p"]).collect()] == [(2, "proc", "ausente"), (6, "proc", "invalido")]
    assert contracts.items(spark.createDataFrame([(1, "[1]"), (2, "no")], "p int, body string"), ["p"]).count() == 0


def test_paging(spark):
    rows = [("ok", 0, 2, 3, False), ("ok", 1, 1, 3, True), ("gap", 0, 2, 3, False), ("gap", 2, 1, 3, True), ("sum", 0, 2, 3, True), ("tot", 0, 1, 1, False), ("tot", 1, 1, 2, True), ("end", 0, 1, 2, True), ("end", 1, 1, 2, False)]
    out = contracts.paging(spark.createDataFrame(rows, "coleta string, numero int, elementos int, total int, ultima boolean"))
    assert {r.coleta: r.violacao for r in out.collect()} == {"ok": None, "gap": "página ausente ou repetida", "sum": "soma difere do total", "tot": "total mudou entre páginas", "end": "marca de última página"}
    rows = spark.createDataFrame([("c", 0, 0, 2020, 1), ("c", 0, 1, 2020, 5), ("c", 1, 0, 2020, 3)], "coleta string, p int, i int, ano int, n int")
    assert [r.n for r in contracts.out_of_order(rows, "coleta", "p", "i", ["ano", "n"]).collect()] == [3]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "p int, sha256 string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "p int, sha256 string")
    assert sorted(r.p for r in contracts.second_read(a, b, ["p"]).collect()) == [2, 3]


def test_shapes(spark):
    ref = contracts.path_types(spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2}',)], "j string"), "j")
    assert {r.caminho: (r.tipos, r.registros, r.obrigatorio) for r in ref.collect()} == {"$.a": ("BIGINT", 2, True), "$.b": ("STRING", 1, False)}
    new = contracts.path_types(spark.createDataFrame([('{"b":null,"c":true}',)], "j string"), "j")
    assert {r.caminho: r.mudanca for r in contracts.shape_changes(ref, new).collect()} == {"$.a": "removido", "$.c": "novo"}


def words(total, shift=0.0):
    heads = [("d", 1, 300.0 + 50 * i + shift, 100.0, 310.0 + 50 * i + shift, 105.0, t) for i, t in enumerate(statements.PAGE_LABELS)]
    label = [("d", 1, 10.0 + 30 * i, 120.0 + i % 2, 30.0 + 30 * i, 125.0, w) for i, w in enumerate("TOTAL (III) = x".split())]
    return heads + label + [("d", 1, 295.0 + 50 * i, 121.0, 315.0 + 50 * i, 126.0, t) for i, t in enumerate(total)]


def test_cells_from_words(spark):
    schema = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    numbers = ["1.000,00", "2,50", "-"] + ["1,00"] * 9
    out = {r.coluna: r.valor for r in statements.cells(spark.createDataFrame(words(numbers), schema)).collect()}
    assert out["a"] == 100000 and out["b"] == 250 and out["c"] == 0 and len(out) == 12
    assert statements.cells(spark.createDataFrame(words(numbers[:11]), schema)).count() == 0
    assert statements.cells(spark.createDataFrame(words(numbers, 120.0), schema)).count() == 0
    whole = words(numbers)
    for bad in (whole[1:], [*whole, ("d", 2, 1.0, 1.0, 2.0, 2.0, "x")], [*whole, *[(*w[:3], w[3] + 40, *w[4:6], "9,99" if w[6] == "2,50" else w[6]) for w in whole[12:]]]):  # a label, one page, one value a cell
        assert statements.cells(spark.createDataFrame(bad, schema)).count() == 0
    # heights that creep by less than the tolerance from word to word are still told apart from the first number's
    creeping = [*whole[:15], *[(d, p, x0, 121.0 + 0.4 * i, x1, y1, t) for i, (d, p, x0, _, x1, y1, t) in enumerate(whole[16:])]]
    assert statements.cells(spark.createDataFrame(creeping, schema)).count() == 0
    ends = spark.createDataFrame([("JANEIRO A ABRIL 2.024",), ("JANEIRO A DEZEMBRO 2.023 x",), ("JANEIRO A MAIO",)], "t string").select(statements.period_end(F.col("t")).cast("string").alias("e"))
    assert [r.e for r in ends.collect()] == ["2024-04-30", "2023-12-31", None]


def test_declaration(spark):
    labels = [r[0] for r in spark.createDataFrame([("x (a)",), ("Saldo e = (a+ b)",), ("Saldo k = (f+g)",), ("Saldo Total L = (e + k)",), ("RPNP - Liquidados",), ("Saldo (b)",), ("(a) x",)], "t string").select(statements.column_of(F.col("t"))).collect()]
    assert labels == ["a", "e", "k", "L", "h", "k", None]
    items = [("m", t, "TOTAL (III)", v) for t, v in (("x (a)", "10.00"), ("x (c)", "4.00"), ("Saldo e", "6.00"), ("Saldo Total L", "6.00"))] + [("m", "x (a)", "PODER EXECUTIVO", "1"), ("m", "x (a)", "PODER EXECUTIVO", "2"), ("m", "Saldo e", "RESTOS A PAGAR (EXCETO", "1.005")]
    out = statements.declaration(spark.createDataFrame(items, "doc string, coluna string, conta string, valor string"), ["doc"]).collect()
    assert {r.linha: r.situacao for r in out} == {"TOTAL (III)": "completa", "PODER EXECUTIVO": "recusada", "RESTOS A PAGAR (EXCETO": "recusada"}
    total = {r.coluna: r.valor for r in out if r.linha == "TOTAL (III)"}
    assert (total["a"], total["b"], total["L"]) == (1000, 0, 600)


def test_validation_and_layouts(spark):
    cell = lambda doc, row, **v: [(doc, row, c, v.get(c, 0)) for c in statements.LETTERS]
    one, tot = statements.ROW_LABELS[0], statements.ROW_LABELS[3]
    rows = cell("ok", one, a=5, e=5, L=5) + cell("ok", tot, a=5, e=5, L=5) + cell("id", one, a=5) + cell("id", tot, a=5) + cell("sum", one, a=5, e=5, L=5) + cell("sum", tot, a=6, e=6, L=6) + cell("no", one)
    out = statements.validate(spark.createDataFrame(rows, "doc string, linha string, coluna string, valor long"), ["doc"])
    assert {r.doc: r.violacao for r in out.collect()} == {"ok": None, "id": "identidade", "sum": "TOTAL difere de (I) + (II)", "no": "sem TOTAL"}
    text = spark.createDataFrame([("x", "a TOTAL (III) 5,00 - - - 5,00 - - - - - - 5,00 tail"), ("y", "TOTAL (III) 5,00 1,00")], "doc string, text string")
    assert statements.twelve_after(text).where("valor <> 0").count() == 3


def test_store(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "o").mkdir()
    man = dict(formato=1, snapshot_uid="u1", tipo="rp", endpoint="e", parametros={"ex": "2024"}, coletada_em="2024-01-01T10:00:00", status="completa", respostas=[dict(ordem=1, url="u", http_status=200, recebida_em="2024-01-01T10:05:00", sha256="x", tamanho=3)])
    (tmp_path / "m/a.json").write_text(json.dumps(man))
    (tmp_path / "m/b.json").write_text("{broken")
    read = store.read_manifests(spark, str(tmp_path / "m")).cache()
    assert read.where("__corrupt is not null").count() == 1
    c = store.collections(read).first()
    assert (c.snapshot_uid, c.evidencia, str(c.concluida_em)) == ("u1", "ultima_resposta", "2024-01-01 13:05:00")
    assert store.responses(read).first().sha256 == "x"
    good = hashlib.sha256(b"foo").hexdigest()
    (tmp_path / f"o/{good}").write_bytes(b"foo")
    (tmp_path / f"o/{'0' * 64}").write_bytes(b"bar")
    objects = store.read_objects(spark, str(tmp_path / "o"))
    assert {r.sha256: r.integro for r in objects.collect()} == {good: True, "0" * 64: False}
    new = store.new_objects(spark.createDataFrame([(bytearray(b"foo"),), (bytearray(b"new"),), (bytearray(b"new"),)], "body binary"), objects)
    assert [r.tamanho for r in new.collect()] == [3]
    files = spark.createDataFrame([("g_p1.json", "a"), ("g_p2.json", "b"), ("h_p1.json", "a"), ("h_p1.json", "c"), ("other", "x")], "path string, sha256 string")
    assert {r.grupo: (r.paginas, r.completo) for r in store.import_groups(files).collect()} == {"g": (2, True), "h": (1, False)}
    body = json.dumps([{"list": [{"list": [{"idArquivo": 1, "valor": "RREO Anexo VII", "nomeArquivo": "a.pdf", "dataArquivo": "d"}, {"idArquivo": 2, "valor": "x", "nomeArquivo": "b.pdf", "dataArquivo": "d"}]}]}])
    assert [r.idArquivo for r in store.publications(spark.createDataFrame([(body,)], "body string")).collect()] == [1]
    store.append_only(files, str(tmp_path / "layer"))
    try:
        store.append_only(files, str(tmp_path / "layer"))
        raise AssertionError("overwrote a layer")
    except Exception as e:
        assert "exist" in str(e).lower()


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", 1, "completa", "2024-01-01T00:00:00", 1), ("a", 1, "completa", "2024-01-01T00:00:00", 1), ("b", 1, "completa", "2024-01-02T00:00:00", 2), ("c", 1, "incompleta", "2024-01-03T00:00:00", 3)]
    (src / "1.json").write_text("\n".join(json.dumps(dict(uid=u, entidade=k, ex=2024, df="2024-12-31", status=s, concluida_em=t, valor=v)) for u, k, s, t, v in rows))
    stream = manifests.read_collections(spark, str(src))
    manifests.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.uid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    q = manifests.current(manifests.read_collections(spark, str(src))).writeStream.outputMode("update").format("memory").queryName("atual").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.uid for r in spark.table("atual").collect()][-1] == "b"
    q = manifests.arrivals(manifests.read_collections(spark, str(src))).writeStream.outputMode("update").format("memory").queryName("chegadas").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.coletas for r in spark.table("chegadas").collect()) >= 3
