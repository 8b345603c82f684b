"""Whole answers and inquiries on small tables, with results worked out by hand."""

import json

from pyspark.sql import functions as F

from snapledger.operators import answers, inquiry
from snapledger.sources import movements


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_context_is_the_newest_current_derivation(spark):
    d = "id long, normalizacao long, vigencia_em string"
    runs = spark.createDataFrame([(1, 7), (2, None), (3, None)], "id long, ultima long")
    read = spark.createDataFrame([(2, 40), (2, 41), (1, 99)], "normalizacao long, coleta long")
    got = lambda ds: rows(answers.context(spark.createDataFrame(ds, d), runs, read), "derivacao", "normalizacao", "limite")
    assert got([(10, 1, None), (11, 2, "2024-01-01")]) == [(10, 1, 7)]
    assert got([(10, 1, None), (12, 2, None)]) == [(12, 2, 41)]  # a run that didn't write its limit down
    assert got([(13, 3, None)]) == [(13, 3, 0)]  # and has no rows either
    assert got([(11, 2, "2024-01-01")]) == [] and got([]) == []


def test_what_each_instant_had_seen(spark):
    r = spark.createDataFrame([("x", 1, "2024-01-02"), ("x", 1, "2024-01-09"), ("x", 2, "2024-01-05"), ("y", None, "2024-01-01")], "k string, ex long, t string").withColumn("t", F.to_timestamp("t"))
    at = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-06",)], "em string").withColumn("em", F.to_timestamp("em"))
    got = answers.seen_by(r, at, ["k"], "ex", "t").withColumn("d", F.date_format("em", "dd"))
    assert rows(got.where("k = 'x'"), "d", "vistos") == [("03", [1]), ("06", [1, 2])]
    assert all(v == [] for (v,) in rows(got.where("k = 'y'"), "vistos"))


def test_catalog_keeps_entities_of_any_source(spark):
    e = spark.createDataFrame([(1, "a", "n1"), (2, "a", None)], "entidade long, em string, nome string")
    y = spark.createDataFrame([(1, "a", [1997, 1998]), (3, "a", [1999]), (4, "a", [])], "entidade long, em string, exercicios array<long>")
    s = spark.createDataFrame([(5, "a", [1998])], "entidade long, em string, vistos array<long>")
    assert rows(answers.catalog(e, y, s, 1998), "entidade", "no_catalogo", "primeiro", "ultimo", "vistos", "situacao") == [
        (1, True, 1997, 1998, "", "no catálogo oficial"), (2, True, None, None, "", "sem catálogo de exercícios"), (3, False, 1999, 1999, "", "fora do catálogo oficial"), (4, False, None, None, "", "sem catálogo de exercícios"), (5, False, None, None, "1998", "sem catálogo de exercícios"),
    ]


def test_reasons_follow_the_entities(spark):
    s = spark.createDataFrame([(1, 2000, "d", "sem_coleta"), (2, 2000, "d", "ambiguo"), (3, 2000, "d", "sem_coleta"), (4, 2000, "d", "com_dados"), (1, 2001, "d", "sem_rp"), (1, 2002, "d", "inexistente")], "entidade long, ex long, df string, situacao string")
    t = answers.STATE_TEXTS
    assert rows(answers.reasons(s), "ex", "motivo") == [(2000, f"{t['sem_coleta']} para a(s) entidade(s) [1, 3]; {t['ambiguo']} para a(s) entidade(s) [2]"), (2001, None), (2002, answers.NONE_SUMMED)]
    own = spark.createDataFrame([(9, "sem_coleta"), (9, "com_dados"), (9, "inexistente")], "e long, s string").select("s", answers.own_reason(F.col("s"), F.col("e")).alias("m"))
    assert rows(own, "s", "m") == [("com_dados", None), ("inexistente", answers.NOT_THERE), ("sem_coleta", "corte não coletado para a(s) entidade(s) [9]")]


def test_dimensions_tell_null_from_total(spark):
    r = spark.createDataFrame([(1, "a", None, 5, 1, 6), (1, "a", "x", 1, 1, 2), (1, None, "x", 2, 0, 1)], "ex long, p string, q string, proc long, aproc long, s1 long")
    assert rows(answers.by_dimensions(r, ["ex"], ["p", "q"]), "dimensao", "chave", "registros", "inscricao", "s1") == [("p", "a", 2, 8, 8), ("p", None, 1, 2, 1), ("q", "x", 2, 4, 3), ("q", None, 1, 6, 6)]
    assert rows(answers.by_dimensions(r.limit(0), ["ex"], ["p", "q"]), "chave") == []


def blocks(spark, parts, tops=None):
    d = spark.createDataFrame(parts, "g long, bloco string, chave string, ordem int, valor long, total long")
    return rows(answers.partition(d, ["g"], tops or {"t": 2}), "chave", "valor", "posicao", "motivo", "decimos")


def test_partitions_close_or_say_why(spark):
    thirds = [(1, "b", k, None, 1, 3) for k in "xyz"]
    assert blocks(spark, thirds) == [("x", 1, 1, None, 334), ("y", 1, 2, None, 333), ("z", 1, 3, None, 333)]
    fixed = [(1, "b", "z", 1, 1, 10), (1, "b", None, 2, 9, 10)]
    assert blocks(spark, fixed) == [("sem classificação", 9, 2, None, 900), ("z", 1, 1, None, 100)]
    assert blocks(spark, [(1, "b", "x", None, 4, 5)])[0][3:] == ("as partes não somam o total (diferença de -1 centavos): o gráfico não é desenhado", None)
    assert blocks(spark, [(1, "b", "x", None, 0, 0)])[0][3:] == ("total zero: não há o que dividir", None)
    assert {b[3] for b in blocks(spark, [(1, "b", "x", None, 6, 5), (1, "b", "y", None, -1, 5)])} == {"há parte negativa, que um gráfico de pizza não representa: veja as colunas"}
    many = [(1, "t", k, None, v, 100) for k, v in zip("abcd", (40, 30, 20, 10))]
    assert blocks(spark, many) == [("a", 40, 1, None, 400), ("b", 30, 2, None, 300), ("demais (2 grupos)", 30, 3, None, 300)]
    assert [b[0] for b in blocks(spark, [(1, "t", k, None, v, 100) for k, v in zip("abc", (50, 30, 20))])] == ["a", "b", "c"]  # a rest of one group is that group


def test_candidates_by_tab(spark):
    cols = "entidade long, ex long, anoempenho long, proc long, aproc long, pago_proc long, pago_aproc long, cancelado_aproc long, liquidado long"
    r = spark.createDataFrame([(1, 2000, 1999, 10, 0, 3, 50, 2, 0), (1, 2000, 1990, 7, 5, 1, 4, 1, 6), (1, 2000, 1990, 0, 0, 9, 9, 9, 9)], cols)
    got = dict(rows(inquiry.candidate_sums(r, ["entidade"]), "coluna", "candidato"))
    assert got == {"a": 7, "b": 10, "c": 4, "d": 2, "f": 5, "g": 0, "h": 6, "i": 4, "j": 1, "e": 11, "k": 0}


def test_absent_cells_are_zero_only_if_the_line_closes(spark):
    whole = dict(a=1, b=2, c=1, d=0, e=2, f=4, g=0, h=9, i=1, j=0, k=3, L=5)
    lines = {"whole": whole, "zeros": {**whole, "d": None, "g": None, "j": None}, "lost": {**whole, "b": None}, "wrong": {**whole, "L": 6}, "none": dict.fromkeys(inquiry.CELLS)}
    d = spark.createDataFrame([(n, *v.values()) for n, v in lines.items()], "n string, " + ", ".join(f"{c} long" for c in inquiry.CELLS))
    got = {r.n: r for r in inquiry.zero_absent(d).collect()}
    assert [(n, got[n].ausentes, got[n].falha) for n in lines] == [("whole", "", None), ("zeros", "d,g,j", None), ("lost", "b", "ausentes sem fechar: b"), ("wrong", "", "L = e + k"), ("none", ",".join(inquiry.CELLS), None)]
    assert (got["zeros"].d, got["zeros"].g, got["lost"].b, got["wrong"].L, got["none"].a) == (0, 0, None, 6, 0)


def test_cells_against_a_declaration(spark):
    r = spark.createDataFrame([("p", "a", 1), ("p", "b", 0), ("q", "a", 1), ("q", "b", 5), ("r", "a", 0)], "doc string, c string, valor long")
    d = spark.createDataFrame([("p", "a", 1), ("q", "a", 2)], "doc string, c string, valor long")
    assert rows(inquiry.cells_compared(r, d, ["doc"], ["c"]), "doc", "comparadas", "diferentes", "igual") == [("p", 1, 0, True), ("q", 1, 2, False), ("r", 0, 0, False)]


def test_layouts_need_a_second_reading_of_every_line(spark):
    s = "doc string, linha string, coluna string, valor long"
    first = spark.createDataFrame([(d, ln, c, 1) for d in "pqrs" for ln in ("x", "y") for c in "ab"], s)
    second = spark.createDataFrame([("p", ln, c, 1) for ln in ("x", "y") for c in "ab"] + [("q", "x", c, 1) for c in "ab"] + [("r", "x", "a", 1), ("r", "x", "b", 2), ("r", "y", "a", 1)], s)
    told = spark.createDataFrame([("p", "x", "a", 7), ("q", "x", "a", 1)], s)
    assert rows(inquiry.layouts_validated(first, second, told, ["doc"], "linha", "coluna"), "doc", "conferidas", "divergentes", "sem_segunda_leitura", "conteudo_diferente", "situacao") == [
        ("p", 4, 0, "", 2, "validado"), ("q", 2, 0, "y", 1, "divergente"), ("r", 4, 2, "", 0, "divergente"), ("s", 0, 0, "x,y", 0, "divergente"),
    ]


def test_states_before_and_after(spark):
    s = "p string, k long, texto string, numero long"
    a = spark.createDataFrame([("x", 1, "t", None), ("x", 2, None, 5), ("x", 3, None, 6), ("x", 4, "u", None), ("y", 1, None, 1)], s)
    b = spark.createDataFrame([("x", 1, "t", None), ("x", 2, None, 7), ("x", 4, "v", None), ("x", 5, None, 0), ("y", 1, None, 1)], s)
    assert rows(inquiry.states_compared(a, b, ["p"], ["k"]), "p", "iguais", "valores", "textos", "novos", "removidos", "identico") == [("x", 1, 1, 1, 1, 1, False), ("y", 1, 0, 0, 0, 0, True)]


def test_movement_items(spark):
    item = dict(data="2020-03-01", tipoLancamento=40, descricaoTipoLancamento=" \t Pagamento\n", valor=1.5, valorALiquidar=None, noLiquidacao=7, exercicioLiquidacao=2019, noPagamento=8, exercicioPagamento=2020, nroDocumento="D", outra=1)
    bare = dict(tipoLancamento=30, valor=2, noLiquidacao=7, valorAPagar="x")
    bad = [dict(valor=v) for v in (None, "1", 1.234, True)] + [{}]
    pages = spark.createDataFrame([(1, json.dumps({"content": [item, bare, *bad]})), (2, "no json"), (3, None), (4, '{"content": []}')], "pagina long, body string")
    got = rows(movements.entries(pages, ["pagina"]), "indice", "descricao", "valor_c", "a_liquidar_c", "a_pagar_c", "efeito", "com_sinal_c", "referencia")
    assert got == [(0, "Pagamento", 150, None, None, "pagamento", 150, "8/2020"), (1, "", 200, None, None, "liquidacao", 200, None)]
    assert rows(movements.refused(pages, ["pagina"]), "indice", "motivo") == [(2, "nulo"), (3, "invalido"), (4, "invalido"), (5, "invalido"), (6, "ausente")]
