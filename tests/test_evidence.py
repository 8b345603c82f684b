"""Cases in a chain, runs paired by content, personal data, nested shapes."""

import json
import random
import re

from pyspark.sql import functions as F

from snapledger.functions.text import CPF_FULL, personal_data_in
from snapledger.operators import identity
from snapledger.operators.integrity import table_differences
from snapledger.sources import shapes


def test_no_case_takes_a_key_twice(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(40), rng.randrange(8)) for g in range(4) for _ in range(60)]
    conditions = {"a": (F.col("v") > 5, lambda v: v > 5), "b": (F.col("v") > 4, lambda v: v > 4), "none": (F.col("v") > 9, lambda v: v > 9), "c": (F.col("v") % 2 == 0, lambda v: v % 2 == 0), "d": (F.col("v") > 4, lambda v: v > 4), "e": (F.col("v") >= 0, lambda v: True), "f": (F.col("v") >= 0, lambda v: True)}
    out = identity.chain(spark.createDataFrame(rows, "g int, k int, v int"), ["g"], ["k"], {n: c for n, (c, _) in conditions.items()})
    want = set()
    for g in range(4):
        taken = set()
        for name, (_, test) in conditions.items():
            free = [k for x, k, v in rows if x == g and test(v) and k not in taken]
            if free:
                taken.add(min(free))
                want.add((g, name, min(free)))
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert identity.chain(spark.createDataFrame([], "g int, k int, v int"), ["g"], ["k"], {"a": F.lit(True)}).count() == 0


def test_renumbered_runs_are_equal(spark):
    parents = [(1, "x", 1), (2, "x", 1), (3, "y", 2), (4, None, 3)]
    children = [(1, "p"), (1, "q"), (2, "p"), (2, "q"), (3, "r"), (4, "s"), (4, "s")]
    to = {1: 90, 2: 80, 3: 70, 4: 60}
    df = lambda rows, names: spark.createDataFrame(rows, names)
    a, b = df(parents, "id long, t string, n int"), df([(to[i], t, n) for i, t, n in parents], "id long, t string, n int")
    pairs = identity.paired(a, b, "id", ["t", "n"])
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert {x for x, _ in got} == {1, 2, 3, 4} and (3, 70) in got and (4, 60) in got and {y for _, y in got} == set(to.values())
    line_a, line_b = df(children, "id long, v string"), [(to[i], v) for i, v in children]
    compare = lambda rows: sorted(map(tuple, table_differences(line_a, identity.renamed(df(rows, "id long, v string"), "id", pairs)).collect()))
    assert compare(line_b) == []
    assert compare([(i, "z" if v == "r" else v) for i, v in line_b]) == [(3, "r", "a"), (3, "z", "b")]
    assert compare(line_b[:-1]) == [(4, "s", "a")]
    more = identity.paired(a, b.unionByName(df([(50, "y", 2)], "id long, t string, n int")), "id", ["t", "n"])
    assert [r.id_b for r in more.where("id_a is null").collect()] == [70]
    # what tells repeats apart comes first: by children here, not by identifier
    told = lambda rows, n: df(rows, "id long, t string, n int, h string")  # noqa: E731, ARG005
    one = identity.paired(told([(1, "x", 1, "h1"), (2, "x", 1, "h2")], 0), told([(7, "x", 1, "h2"), (8, "x", 1, "h1")], 0), "id", ["t", "n"], ["h"])
    assert {(r.id_a, r.id_b) for r in one.collect()} == {(1, 8), (2, 7)}


def right(d):
    return len(set(d)) > 1 and all(sum(int(d[i]) * (n + 1 - i) for i in range(n)) * 10 % 11 % 10 == int(d[n]) for n in (9, 10))


def test_personal_numbers_by_brute_force(spark):
    rng = random.Random(7)
    shown = lambda d: f"{d[:3]}.{d[3:6]}.{d[6:9]}-{d[9:]}"
    made = ["52998224725", "11144477735", "11111111111", "00000000000", "12345678909", *("".join(rng.choice("0123456789") for _ in range(11)) for _ in range(300))]
    texts = [None, "", *(f"a {shown(d)}{rng.choice((' ', ';', '.', '1', 'x'))} {rng.choice(('', '***123***', '****456****', '**123**', '****123****'))} {shown(made[0])}" for d in made)]
    df = spark.createDataFrame([(i, t, i, t) for i, t in enumerate(texts)], "k int, t string, n int, `odd name` string")
    want = set()
    for i, t in enumerate(texts):
        for p, m in enumerate(re.findall(CPF_FULL, t or ""), 1):
            if right(re.sub(r"\D", "", m)):
                want |= {(i, c, "completo", m, p) for c in ("t", "odd name")}
        for p, m in enumerate(re.findall(r"\*{3,4}\d{3}\*{3,4}", t or ""), 1):
            if m not in ("****123****", "***456***"):
                want |= {(i, c, "mascarado", m, p) for c in ("t", "odd name")}
    assert {tuple(r) for r in personal_data_in(df, ["k"]).collect()} == want and {w[2] for w in want} == {"completo", "mascarado"}


def walked(value, path, out):
    kinds = {type(None): "null", bool: "boolean", str: "string", list: "array", dict: "object"}
    out.setdefault(path, set()).add(kinds.get(type(value), "number"))
    for key, v in value.items() if isinstance(value, dict) else [("[]", v) for v in value] if isinstance(value, list) else []:
        walked(v, path + (key if isinstance(value, list) else f".{key}"), out)


def test_nested_shapes(spark):
    def some(rng, depth):
        pick = rng.randrange(7 if depth else 5)
        if pick == 5:
            return [some(rng, depth - 1) for _ in range(rng.randrange(3))]
        if pick == 6:
            return {k: some(rng, depth - 1) for k in rng.sample(["a", "b", "é", "x y"], rng.randrange(4))}
        return [None, True, "s", 1, 2.5][pick]

    rng = random.Random(9)
    values = [some(rng, 4) for _ in range(150)]
    bodies = [(i % 2, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(0, "no json"), (1, None), (2, "{")]
    df = spark.createDataFrame(bodies, "g int, j string")
    got = shapes.shape(shapes.paths(df, "j", ["g"]), ["g"])
    for g in (0, 1):
        want = {}
        for k, v in enumerate(values):
            if k % 2 == g:
                walked(v, "$", want)
        assert {r.caminho: r.tipos for r in got.where(F.col("g") == g).collect()} == {p: "|".join(sorted(t)) for p, t in want.items()}
    assert got.where("g = 2").count() == 0 and shapes.verdict(df.where("g = 2"), "j", got.limit(0).withColumn("x", F.lit(1)), ["g"]).first().resultado == "indisponivel"
    deep = spark.createDataFrame([(0, '{"a":{"b":{"c":1}}}')], "g int, j string")
    assert {r.caminho: r.tipo for r in shapes.paths(deep, "j", ["g"], depth=2).collect()} == {"$": "object", "$.a": "object", "$.a.b": "profundo"}


def test_shape_changes_and_canonical_records(spark):
    shape = lambda *texts: shapes.shape(shapes.paths(spark.createDataFrame([(0, t) for t in texts], "g int, j string"), "j", ["g"]), ["g"])
    reference = shape('{"a":{"b":1,"c":"x"},"l":[{"v":1}]}', '{"a":{"b":null,"c":"y"},"l":[]}')
    found = lambda *texts: {r.caminho: (r.antes, r.agora, r.mudanca) for r in shapes.changes(reference, shape(*texts), ["g"]).collect()}
    assert found('{"l":[{"v":2},{"v":3}],"a":{"c":"z","b":5}}') == {}
    assert found('{"a":{"b":1,"c":null},"l":[{"v":1}]}') == {}  # a field that came empty
    assert found('{"a":{"b":"1","c":"x"},"l":[{"v":1,"w":true}]}') == {"$.a.b": ("null|number", "string", "tipo diferente"), "$.l[].w": (None, "boolean", "novo")}
    assert found('{"a":{"c":"x"},"l":[{"v":1}]}') == {"$.a.b": ("null|number", None, "removido")}
    hashes = lambda t: shapes.shape_hash(shape(t), ["g"]).first().forma_sha256
    assert hashes('{"a":1,"b":[{"x":1,"y":2}]}') == hashes('{"b":[{"y":9,"x":8}],"a":7}') != hashes('{"a":1,"b":[{"x":1,"y":"2"}]}')
    rows = [' { "b" : [ {"y":1, "x":[2,1]} ], "a":null }', '{"a":null,"b":[{"x":[2,1],"y":1}]}', '{"a":null,"b":[{"x":[1,2],"y":1}]}', "{"]
    out = [tuple(r) for r in spark.createDataFrame([(t,) for t in rows], "j string").select(shapes.canonical(F.col("j")), shapes.record_hash(F.col("j"))).collect()]
    assert out[0] == out[1] and out[0][0] == rows[1] and out[2][1] != out[0][1] and out[3] == (None, None)


def test_layouts_are_tried_in_order(spark):
    from snapledger.sources import statements as st

    numbers = {"a": "5,00", "e": "5,00", "L": "5,00"}

    def page(doc, heads, title="JANEIRO A ABRIL 2.016", rows=("RESTOS A PAGAR (EXCETO", "TOTAL (III)"), zero="0,00", values=numbers, pages=1):
        words = [(doc, 1, 10.0 + 30 * k, 20.0, 35.0 + 30 * k, 25.0, t) for k, t in enumerate(title.split())]
        words += [(doc, 1, x, y, x + 8, y + 5, t) for x, y, t in heads]
        for n, row in enumerate(rows):
            y = 210.0 + 20 * n
            words += [(doc, 1, 10.0 + 25 * k, y, 20.0, y + 5, t) for k, t in enumerate(row.split())]
            words += [(doc, 1, 251.0 + 50 * k, y, 259.0 + 50 * k, y + 5, values.get(c, zero)) for k, c in enumerate(st.LETTERS)]
        return words + [(doc, p, 1.0, 1.0, 2.0, 2.0, "x") for p in range(2, pages + 1)]

    at = lambda k: 250.0 + 50 * k
    one = [(at(k), 100.0, t) for k, t in enumerate(st.PAGE_LABELS)]
    two = [(at(k), 180.0, t) for k, t in enumerate(st.HEADS_2016)] + [(at(0) + 9, 190.0, "Em"), (at(1) + 12, 190.0, "Em")]
    three = [w for k, c in enumerate(st.LETTERS) for w in ([(at(k) - 10, 100.0, "("), (at(k), 100.4, c), (at(k) + 10, 99.6, ")")] if c not in "ekL" else [(at(k), 100.0, c), (at(k) + 10, 100.0, "=")])] + [(990.0, 100.0, "("), (1000.0, 100.0, "a"), (1010.0, 100.0, ")")]
    declared = "JANEIRO À FEVEREIRO 2018 / BIMESTRE"
    pages = [
        page("one", one), page("one dash", one, zero="-"), page("two", two, rows=("RESTOS A PAGAR (EXCETO", "EXECUTIVO", "TOTAL (III)")), page("two dash", two, zero="-"), page("three", three, declared), page("three dash", three, declared, zero="-"),
        page("none", two[:-3]), page("order", [(x, y, "Pagos" if t == "Cancelados" else t) for x, y, t in two]), page("period", three), page("pages", one, pages=2), page("rule", one, values={"a": "5,00"}), page("total", three, declared, rows=("TOTAL (III)",)),
    ]
    told, cells = st.read_layouts(spark.createDataFrame([w for p in pages for w in p], "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    a, b, c = st.LAYOUTS
    assert {r.doc: (r.layout, r.fim, r.motivo) for r in told.collect()} == {
        "one": (a, "2016-04-30", None), "one dash": (a, "2016-04-30", None), "two": (b, "2016-04-30", None), "two dash": (None, None, "linhas não lidas"), "three": (c, "2018-02-28", None), "three dash": (c, "2018-02-28", None), "none": (None, None, "colunas não encontradas"),
        "order": (None, None, "colunas não encontradas"), "period": (None, None, "período não encontrado"), "pages": (None, None, "2 páginas"), "rule": (None, None, "identidade"), "total": (None, None, "sem linha (I)"),
    }
    found = {}
    for r in cells.collect():
        found.setdefault(r.doc, {}).setdefault(r.linha, {})[r.coluna] = r.valor
    assert set(found) == {"one", "one dash", "two", "three", "three dash"} and set(found["two"]) == {st.ROW_LABELS[0], "PODER EXECUTIVO", st.ROW_LABELS[3]}
    assert all(row == {x: 500 if x in numbers else 0 for x in st.LETTERS} for rows in found.values() for row in rows.values())
