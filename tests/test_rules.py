"""Worked examples of the accounting rules, and properties of shares, ratios and closings."""

import random

import pytest
from pyspark.sql import functions as F

from snapledger.functions import dates, money, text
from snapledger.operators import cutoffs, integrity, listing, pairing, reconcile, rules, series, validity, variation
from snapledger.operators import indicators as ind
from snapledger.sources import contracts

ZERO = dict(entidade=1, anoempenho=2023, empenho=1, ex=2024, df="2024-12-31", situacao="x", proc=0, aproc=0, pago_proc=0, pago_proc_estornado=0, pago_aproc=0, pago_aproc_estornado=0, cancelado_proc=0, cancelado_aproc=0, liquidado=0, retencao=0)
SCHEMA = "entidade long, anoempenho long, empenho long, ex long, df string, situacao string, proc long, aproc long, pago_proc long, pago_proc_estornado long, pago_aproc long, pago_aproc_estornado long, cancelado_proc long, cancelado_aproc long, liquidado long, retencao long"


def ledger(spark, *rows):
    return spark.createDataFrame([tuple((ZERO | r).values()) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "proc, aproc, liq, canc, p, n",
    [(10000, 0, -10000, 10000, 10000, 0), (130000, 470000, -81968, 551968, 81968, 470000), (0, 522771781, 414356633, 108415148, 0, 108415148), (0, 10000, 0, -1000, 0, -1000), (0, 10000, 0, 4000, 0, 4000), (0, 0, 0, 500, 0, 0)],
)
def test_cancellation_v2(spark, proc, aproc, liq, canc, p, n):
    r = rules.derive(ledger(spark, dict(proc=proc, aproc=aproc, liquidado=liq, cancelado_aproc=canc))).first()
    assert (r.canc_v2_p, r.canc_v2_n) == (p, n)


def test_statement_versions(spark):
    rows = [dict(proc=1300, aproc=4700, liquidado=-800, cancelado_aproc=5500), dict(empenho=2, proc=10000, pago_proc=4000, pago_aproc=1000), dict(empenho=3, aproc=5000, pago_proc=2000, liquidado=2000)]
    v = {r.versao: r for r in rules.statement_columns(rules.derive(ledger(spark, *rows)), ["ex"]).collect()}
    assert [(v[k].d, v[k].j) for k in ("v1", "v2", "v3")] == [(0, 5500), (0, 5500), (800, 4700)]
    assert v["v2"].c == v["v3"].c == 5000 and v["v2"].i == v["v3"].i == 2000 and v["v1"].c == 4000 and v["v1"].i == 0
    assert v["v3"].L == v["v2"].L == v["v2"].S1 and all(r.L == r.e + r.k for r in v.values())


def test_balances_and_categories(spark):
    rng = random.Random(1)
    rows = [dict(empenho=i, **{k: rng.choice([0, rng.randint(-500, 5000)]) for k in ("proc", "aproc", "pago_proc", "pago_aproc", "cancelado_aproc", "liquidado")}) for i in range(200)]
    for r in rules.derive(ledger(spark, *rows)).collect():
        assert r.s1 == r.s2 + r.s3
        assert r.categoria == ("ambos" if r.proc > 0 and r.aproc > 0 else "processado" if r.proc > 0 else "nao_processado" if r.aproc > 0 else "sem_saldo_abertura")
        assert r.canc_v2_p + r.canc_v2_n == (r.cancelado_aproc if r.proc > 0 or r.aproc > 0 else 0)


def test_anomalies(spark):
    rows = [dict(liquidado=-1), dict(empenho=2, pago_proc=5), dict(empenho=3, cancelado_proc=1, proc=1), dict(empenho=1500, proc=1), dict(empenho=5, anoempenho=2024, aproc=1)]
    found = {(r.empenho, r.tipo) for r in rules.anomalies(ledger(spark, *rows), 1, 1000).collect()}
    assert found == {(1, "LIQ-NEG"), (1, "SEM-SALDO-ABERTURA"), (2, "PAGOPROC-SEM-PROC"), (2, "SEM-SALDO-ABERTURA"), (3, "CANCPROC-NZ"), (1500, "COPIA-24"), (5, "ANOEMP-FUTURO")}


def test_pairs_and_consolidation(spark):
    rows = [dict(empenho=1001, proc=3000, pago_proc=1000), dict(entidade=2, empenho=1, proc=3000), dict(empenho=1002, aproc=7), dict(entidade=2, empenho=9, proc=5000), dict(empenho=1003, situacao=None, proc=1), dict(entidade=2, empenho=3, situacao=None, proc=2)]
    rec = rules.derive(ledger(spark, *rows))
    found = {r.a_empenho: (r.relacao, r.lado) for r in pairing.pairs(rec, 1, 2, 1000, ["situacao"]).collect()}
    assert found == {1001: ("igual", "A"), 1003: ("outra", "nenhum")}
    assert [r.empenho for r in pairing.unpaired(rec, 1, 2, 1000, ["situacao"]).collect()] == [1002]
    left = {(r.entidade, r.empenho) for r in pairing.consolidated(rec, 1, 2, 1000, ["situacao"]).collect()}
    assert left == {(1, 1001), (1, 1002), (1, 1003), (2, 9), (2, 3)}  # the original of 1001, idle and of the same inscription, is gone; the copy stays
    assert pairing.consolidated(rec, 1, 2, 1000, ["situacao"], first=2025).count() == 6
    less = {r.coluna: r.ajuste for r in pairing.adjustments(pairing.pairs(rec, 1, 2, 1000, ["situacao"]), "v4").collect()}
    assert less["b"] == -3000 and less["S1"] == -3000 and less["L"] == -3000 and less["S2"] == 0
    assert pairing.adjustments(pairing.pairs(rec, 1, 2, 1000, ["situacao"]), "v1").where("coluna = 'b'").first().ajuste == -3000


def test_consolidated_view(spark):
    """100 + copy 30 (paid 10) at the one entity, original 30 + own 50 at the other, in hundreds of cents."""
    rows = [dict(entidade=7, empenho=1, aproc=10000), dict(entidade=7, empenho=2400005, aproc=3000, pago_aproc=1000), dict(entidade=8, empenho=5, aproc=3000), dict(entidade=8, empenho=6, aproc=5000)]
    rec = rules.derive(ledger(spark, *rows))
    before = ind.indicators(rec, ["ex"]).first()
    after = ind.indicators(pairing.consolidated(rec, 7, 8, 2400000, ["situacao"]), ["ex"]).first()
    assert (before.inscricao, after.inscricao, after.s1, after.registros, after.pagos) == (21000, 18000, 17000, 3, 1000)
    for entity, total in ((7, 13000), (8, 8000)):  # an entity's own view consolidates nothing
        own = pairing.consolidated(rec.where(F.col("entidade") == entity), 7, 8, 2400000, ["situacao"])
        assert ind.indicators(own, ["ex"]).first().inscricao == total
    by_entity = {r.entidade: r.s1 for r in ind.indicators(pairing.consolidated(rec, 7, 8, 2400000, ["situacao"]), ["entidade"]).collect()}
    assert by_entity == {7: 12000, 8: 5000}
    relation = lambda a, b: pairing.pairs(rules.derive(ledger(spark, dict(entidade=7, empenho=2400005, **a), dict(entidade=8, empenho=5, **b))), 7, 8, 2400000, []).first().relacao
    assert relation(dict(aproc=2000), dict(proc=3000, pago_proc=1000)) == "a_e_saldo_final_de_b" and relation(dict(aproc=1999), dict(proc=3000, pago_proc=1000)) == "outra"


def test_copies_before_their_first_year(spark):
    """Own 100 and copy 30: the copy is out before its first year, and in from then on."""
    rows = [dict(ex=x, anoempenho=x - 1, empenho=e, aproc=v) for x in (2025, 2026) for e, v in ((1, 10000), (2400001, 3000))]
    kept = rules.derive(ledger(spark, *rows)).where(~(pairing.is_copy(1, 2400000) & (F.col("ex") < 2026)))
    assert {r.ex: r.g for r in rules.statement_columns(kept, ["ex"], ("v3",)).collect()} == {2025: 10000, 2026: 13000}


def test_scope_of_an_extra_entity(spark):
    per = spark.createDataFrame([(2020, "2020-12-31"), (2021, "2021-04-30"), (2021, "2021-06-30")], "ex long, df string")
    got = per.select("ex", "df", *[c.alias(n) for n, c in zip("tsr", cutoffs.extra_entity(F.col("ex"), F.to_date("df"), [("2020-6", "inclui", "comprovado"), ("2021-2", "exclui", "provavel")], ("exclui", "inconclusivo"), {"provavel": "p", "inconclusivo": "i"}), strict=True)])
    assert [tuple(r)[2:] for r in got.orderBy("df").collect()] == [("inclui", "comprovado", None), ("exclui", "provavel", "p"), ("exclui", "inconclusivo", "i")]
    states = spark.createDataFrame([(1, 1, "a", "com_dados"), (2, 1, "a", "sem_rp"), (1, 1, "b", "com_dados"), (2, 1, "b", "ambiguo"), (1, 1, "c", "inexistente"), (9, 1, "c", "fora_do_escopo")], "entidade long, ex long, df string, situacao string")
    assert {r.df: (r.somadas, r.faltam, r.fora, r.fora_do_escopo, r.motivo) for r in cutoffs.gate(states).collect()} == {"a": (2, "", "", "", None), "b": (1, "2", "", "", "faltam entidades: 2"), "c": (0, "", "1", "9", "nenhuma entidade com snapshot")}


def test_a_repeated_key_is_never_current(spark):
    """The newest snapshot has a repeated key: the one before counts; without one, none does."""
    rows = [("a", 1, "2024-01-01"), ("b", 1, "2024-02-01"), ("c", 2, "2024-02-01")]
    snap = spark.createDataFrame(rows, "uid string, k long, concluida_em string")
    reasons = spark.createDataFrame([("b", "VALOR-RECUSADO"), ("b", "CHAVE-DUP"), ("c", "CHAVE-DUP")], "uid string, motivo string")
    refused = contracts.refused_collections(reasons, "uid", "motivo")
    assert {r.uid: r.motivo for r in refused.collect()} == {"b": "CHAVE-DUP", "c": "CHAVE-DUP"}
    assert {r.k: r.uid for r in validity.current(snap, ["k"], ["concluida_em", "uid"], ["uid"], F.lit(True), refused=refused).collect()} == {1: "a"}


def test_filters_and_levels(spark):
    for bad in (dict(anoempenho=-1), dict(anoempenho=True), dict(categoria="x"), dict(programatica="12a"), dict(tipo_credor="outro"), dict(cnpj="52998224725"), dict(faixa="c"), dict(orgao="x1"), dict(sem_classificacao="nome"), dict(desconhecido=1)):
        with pytest.raises(ValueError):
            listing.filters(**bad)
    assert listing.filters(cnpj="12345678000190", faixa="b", programatica="12")[1] == {"cnpj": "12.345.678/0001-90", "faixa": "b", "programatica_comeca_com": "12"}
    assert [listing.clamp(n) for n in (-5, 0, 7, 9999)] == [1, 1, 7, 500]
    df = spark.createDataFrame([(1, "ACME", "12.345.678/0001-90"), (2, "JOAO 12345678", "***123***")], "k int, credor string, cnpj string")
    assert listing.at_level(df, "interno").columns == df.columns
    shown = {r.k: (r.credor_publico, r.tipo_credor) for r in listing.at_level(df, "publico").collect()}
    assert shown == {1: ("ACME", "pessoa jurídica"), 2: ("[nome de pessoa física omitido]", "pessoa física")}
    with pytest.raises(ValueError):
        listing.at_level(df, "x")
    hidden = listing.redacted(spark.createDataFrame([("credor", "x", None), ("proc", "1", "2")], "campo string, antes string, depois string"))
    assert {tuple(r) for r in hidden.collect()} == {("credor", "[restrito]", "[restrito]"), ("proc", "1", "2")}


def test_movement_codes(spark):
    df = spark.createDataFrame([(c,) for c in (20, 33, 40, 41, 51, 99)], "t long")
    of = lambda v: {r.t: tuple(r)[1:] for r in df.select("t", *rules.interpret(F.col("t"), F.lit("l"), F.lit("p"), v)).collect()}
    assert of("v2") == {20: ("empenho", 1, None), 33: ("em_liquidacao", 0, "l"), 40: ("pagamento", 1, "p"), 41: ("estorno_pagamento", -1, "p"), 51: ("estorno_retencao", -1, "l"), 99: ("desconhecido", 0, None)}
    assert of("v1")[33] == ("desconhecido", 0, None)


def test_scope_decision(spark):
    rows = [(130, None, 30, 100), (100, None, 30, 100), (130, 100, 30, 100), (None, 130, 30, 100), (101, None, 30, 100), (129, None, 30, 100), (115, None, 30, 100), (None, None, 30, 100), (100, None, 0, 100)]
    df = spark.createDataFrame(rows, "o long, p long, own long, rest long")
    out = [tuple(r) for r in df.select(*reconcile.scope_decision(F.col("o"), F.col("p"), F.col("own"), F.col("rest"), 2020, F.lit(2021))).collect()]
    assert out == [("inclui", "comprovado"), ("exclui", "comprovado"), ("inclui", "contraditorio"), ("inclui", "comprovado pelo portal"), ("exclui", "provavel"), ("inclui", "provavel"), ("exclui", "inconclusivo"), ("exclui", "inconclusivo"), ("inclui", "comprovado")]


def test_decisions_and_verdicts(spark):
    rows = [("operacional", True, "f", "tests/a.py::b", 1, None), ("experimental", True, "f", None, None, None), ("experimental", False, "f", None, None, "r"), ("operacional", False, " ", "tests/a.py::b", None, None), ("operacional", False, "f", "x", None, None), ("operacional", True, "f", "tests/a.py::b", None, " ")]
    df = spark.createDataFrame(rows, "situacao string, compoe boolean, fonte string, teste string, evidencia long, ressalva string")
    assert [r[0] for r in df.select(integrity.decision_violation()).collect()] == [None, "só regra operacional compõe", "ressalva só na promoção", "sem fonte", "sem teste de regressão", "sem evidência nem ressalva"]
    cases = {1: ([(False, True)], [], [True], "reprovada"), 2: ([(None, True), (True, True)], ["x"], [True], "incompleta"), 3: ([(True, True)], ["x", "y", "x"], [True], "aprovada_com_ressalvas"), 4: ([(True, True), (None, False)], [], [True, True], "aprovada_sem_ressalvas"), 5: ([(True, True)], [], [True, False], "aprovada_com_ressalvas"), 6: ([(True, True)], [], [], "aprovada_sem_ressalvas"), 7: ([(False, False), (None, True)], [], [], "reprovada")}
    gates = spark.createDataFrame([(c, str(i), ok, must) for c, x in cases.items() for i, (ok, must) in enumerate(x[0])], "c int, portao string, ok boolean, obrigatorio boolean")
    pending = spark.createDataFrame([(c, t) for c, x in cases.items() for t in x[1]], "c int, tipo string")
    documents = spark.createDataFrame([(c, d) for c, x in cases.items() for d in x[2]], "c int, conferido boolean")
    out = {r.c: r for r in integrity.homologation(gates, pending, documents, "c").collect()}
    assert {c: r.resultado for c, r in out.items()} == {c: x[3] for c, x in cases.items()}
    assert (out[3].pendencias, out[3].tipos, out[5].cobertura_completa, out[2].tecnica, out[4].tecnica) == (3, "x,y", False, False, True)


def test_long_lists_are_ranked_in_parts(spark):
    """The prefix scan over many ranges, with ties, against a plain loop."""
    rng = random.Random(4)
    rows = [(g, k, rng.choice([-3, -1, 0, 1, 2, 2, 5])) for g in range(3) for k in range(rng.randint(1, 90))]
    found = spark.createDataFrame(rows, "ex long, k long, contribuicao long")
    out = {(r.ex, r.k): (r.posicao, r.acumulado, r.pagina, r.subtotal, r.ultima) for r in variation.ranked(found, ["ex"], ["k"], 7).collect()}
    want = {}
    for g in range(3):
        mine = sorted(((-c, k) for x, k, c in rows if x == g and c))
        for n, (c, k) in enumerate(mine):
            p = n // 7
            want[(g, k)] = (n + 1, -sum(x for x, _ in mine[: n + 1]), p, -sum(x for x, _ in mine[7 * p : 7 * p + 7]), (p + 1) * 7 >= len(mine))
    assert out == want


def test_roll_up_needs_every_entity(spark):
    per = spark.createDataFrame([(0, 1, 5), (1, 1, 7), (0, 2, 5)], "entidade long, ex long, v long")
    catalog = spark.createDataFrame([(0,), (1,)], "entidade long")
    out = {r.ex: (r.situacao, r.ausentes, r.v) for r in ind.only_if_all_present(per, catalog, ["ex"], ["v"]).collect()}
    assert out == {1: ("com_dados", 0, 12), 2: ("municipio_indisponivel", 1, None)}


def test_shares_sum_to_1000(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.randint(0, 10**12)) for g in range(40) for k in range(rng.randint(1, 9))] + [(99, 0, 0), (98, 0, -1), (98, 1, 5)]
    out = money.largest_remainder(spark.createDataFrame(rows, "g long, k long, v long"), ["g"], "v", "k").groupBy("g").agg(F.sum("share").alias("s")).collect()
    assert {r.s for r in out if r.g < 98} == {1000} and {r.s for r in out if r.g >= 98} == {None}


def test_half_up_and_formats(spark):
    df = spark.createDataFrame([(1, 2000), (1, 3), (5, 0)], "p long, t long")
    assert [r.x for r in df.select(money.half_up_tenths("p", "t").alias("x")).collect()] == [1, 333, None]
    df = spark.createDataFrame([(123456789,), (-5,), (0,), (None,)], "v long")
    assert [r.x for r in df.select(money.format_cents(F.col("v")).alias("x")).collect()] == ["1.234.567,89", "-0,05", "0,00", None]
    df = spark.createDataFrame([("1.234,56",), ("-0,05",), ("12,3",), ("1,234.56",), ("",)], "t string")
    assert [r.x for r in df.select(money.text_cents(F.col("t")).alias("x")).collect()] == [123456, -5, None, None, None]


def test_top_with_rest(spark):
    rows = [(1, n, v) for n, v in zip("abcdefg", (9, 8, 8, 5, 4, 1, 1))] + [(2, n, 1) for n in "abcdef"]
    out = ind.top_with_rest(spark.createDataFrame(rows, "ex long, n string, v long"), ["ex"], "n", "v", 5).collect()
    assert {(r.grupo, r.v) for r in out if r.ex == 1} == {("a", 9), ("b", 8), ("c", 8), ("d", 5), ("e", 4), ("demais (2 grupos)", 2)}
    assert {r.grupo for r in out if r.ex == 2} == set("abcdef")


def test_fixed_groups_and_closing(spark):
    other = spark.createDataFrame([(1, "ambos", 3), (1, None, 2), (1, "nova", 1)], "ex long, categoria string, n long")
    assert ind.with_fixed_groups(other, spark, other, ["ex"], "categoria", rules.CATEGORIES, ["n"]).agg(F.sum("n"), F.count(F.lit(1))).first() == (6, 6)
    found = spark.createDataFrame([(1, "ambos", 3)], "ex long, categoria string, n long")
    out = {r.categoria: r.n for r in ind.with_fixed_groups(found, spark, found, ["ex"], "categoria", rules.CATEGORIES, ["n"]).collect()}
    assert out == {"ambos": 3, "processado": 0, "nao_processado": 0, "sem_saldo_abertura": 0}
    total = spark.createDataFrame([(1, 3), (2, 1)], "ex long, n long")
    assert {r.ex: r.fecha for r in ind.closing(found, total, ["ex"], "n").collect()} == {1: True, 2: False}


def test_variation(spark):
    before = spark.createDataFrame([(1, 100), (2, 50), (3, 30), (4, 20)], "k long, s long")
    after = spark.createDataFrame([(1, 70), (3, 30), (4, 40), (5, 25), (6, 20)], "k long, s long")
    found = variation.contributions(before, after, ["k"], "s").withColumn("ex", F.lit(1))
    assert {r.k: (r.classe, r.contribuicao) for r in found.collect()} == {1: ("reduziu", -30), 2: ("retirada", -50), 3: ("igual", 0), 4: ("aumentou", 20), 5: ("nova", 25), 6: ("nova", 20)}
    groups = {r.grupo: (r.registros, r.soma) for r in variation.groups(found, ["ex"], ["k"], 1).collect()}
    assert groups == {"maiores aumentos": (1, 25), "outros aumentos": (2, 40), "maiores reduções": (1, -50), "outras reduções": (1, -30), "sem variação": (1, 0)}
    pages = variation.ranked(found, ["ex"], ["k"], 2).orderBy("posicao").collect()
    assert [(r.k, r.acumulado, r.pagina, r.subtotal, r.ultima) for r in pages] == [(5, 25, 0, 45, False), (4, 45, 0, 45, False), (6, 65, 1, -10, False), (1, 35, 1, -10, False), (2, -15, 2, -50, True)]


def test_field_differences_and_impact(spark):
    a = spark.createDataFrame([(1, 10, None), (2, 5, 5)], "k long, x long, y long")
    b = spark.createDataFrame([(1, 12, None), (3, 1, None)], "k long, x long, y long")
    found = variation.differing_fields(a, b, ["k"], ["x", "y"])
    assert {(r.k, r.campo, r.antes, r.depois, r.tipo) for r in found.collect()} == {(1, "x", 10, 12, "alterado"), (2, "x", 5, None, "removido"), (2, "y", 5, None, "removido"), (3, "x", None, 1, "novo")}
    assert {(r.campo, r.novos, r.removidos, r.alterados, r.impacto) for r in variation.impact(found, []).collect()} == {("x", 1, -5, 2, -2), ("y", 0, -5, 0, -5)}


def test_series_never_skips_a_gap(spark):
    universe = spark.createDataFrame([(1, d) for d in (1, 2, 3, 4)], "e long, d long")
    got = spark.createDataFrame([(1, 1, 10), (1, 2, 15), (1, 4, 20)], "e long, d long, v long")
    out = series.series(universe, got, ["e"], ["d"], "v").orderBy("d").collect()
    assert [(r.v, r.situacao, r.diferenca) for r in out] == [(10, "com_dados", None), (15, "com_dados", 5), (None, "sem_coleta", None), (20, "com_dados", None)]
    points = spark.createDataFrame([(1, "2020-04-30"), (1, "2020-08-31"), (2, "2020-08-31"), (2, "2020-12-31")], "e long, df string")
    assert {r.e: r.df for r in series.representative(points, ["e"]).collect()} == {1: "2020-08-31", 2: "2020-12-31"}


def test_validity(spark):
    rows = [("a", 1, "completa", "2024-01-01", 1), ("b", 1, "completa", "2024-01-03", 2), ("c", 1, "incompleta", "2024-01-05", 3), ("d", 1, "completa", None, 4), ("e", 2, "completa", "2024-01-09", 5)]
    snap = spark.createDataFrame(rows, "uid string, k long, status string, concluida_em string, v long")
    run = lambda **x: {r.k: r.uid for r in validity.current(snap, ["k"], ["concluida_em", "uid"], ["uid", "v"], F.col("status") == "completa", **x).collect()}
    assert run() == {1: "b", 2: "e"} and run(em=F.lit("2024-01-02")) == {1: "a"} and run(refused=snap.where("uid = 'b'")) == {1: "a", 2: "e"}
    assert {r.k: (r.mais_novo, r.vigente) for r in validity.newest_refused(snap, ["k"], ["concluida_em", "uid"], "uid", F.col("status") != "completa").collect()} == {1: ("c", "b")}
    instants = spark.createDataFrame([("2024-01-02",), ("2024-01-04",), ("2024-01-10",)], "em string")
    found = validity.as_of(snap.where("status = 'completa' and concluida_em is not null"), instants, ["k"], "concluida_em", ["concluida_em", "uid"], ["uid"]).collect()
    assert {(r.k, r.em): r.uid for r in found} == {(1, "2024-01-02"): "a", (1, "2024-01-04"): "b", (1, "2024-01-10"): "b", (2, "2024-01-10"): "e"}


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, "z")], "k long, c string")
    assert {r.k: (r.vezes, r.tipo) for r in validity.repeated_keys(rows, ["k"], F.col("c")).collect()} == {1: (2, "exata"), 2: (2, "conflitante")}


def test_explanations(spark):
    diffs = spark.createDataFrame([(1, 2020, "d", 5), (1, 2020, "j", 0), (2, 2020, "j", 3), (1, 2021, "d", 1)], "entidade long, ex long, coluna string, diferenca long")
    catalog = spark.createDataFrame([([2020], None, "d", "x", 2), ([2020], 2, None, "y", 1)], "anos array<bigint>, entidade bigint, coluna string, texto string, certeza int")
    out = reconcile.explain(diffs, catalog, ["entidade", "coluna"])
    assert {(r.entidade, r.ex, r.coluna): (r.situacao, r.explicacao) for r in out.collect()} == {(1, 2020, "d"): ("explicada", "x"), (1, 2020, "j"): ("sem diferença", ""), (2, 2020, "j"): ("hipótese", "y"), (1, 2021, "d"): ("não determinada", "")}
    assert {r.ex: r.situacao for r in reconcile.summary(out, ["ex"]).collect()} == {2020: "parcialmente explicada", 2021: "não determinada"}
    wide = spark.createDataFrame([(1, "c", 5), (1, "i", -5), (2, "c", 5), (2, "i", 5)], "e long, coluna string, diferenca long")
    assert [(r.e, r.valor) for r in reconcile.swaps(wide, ["e"], [("c", "i")]).collect()] == [(1, 5)]


def test_reconcile_keeps_absent_apart_from_zero(spark):
    d = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "k long, valor long")
    c = spark.createDataFrame([(1, 5), (3, 1)], "k long, valor long")
    assert {r.k: (r.diferenca, r.situacao) for r in reconcile.reconcile(d, c, ["k"]).collect()} == {1: (0, "sem diferença"), 2: (None, "sem valor calculado"), 3: (1, "diferença")}


def test_continuity(spark):
    close = spark.createDataFrame([(1, 5, 2, 3), (2, 5, 2, 3), (3, 5, 2, 3), (4, 0, 0, 0)], "k long, s1 long, s2 long, s3 long")
    opened = spark.createDataFrame([(1, 3, 2), (2, 3, 1)], "k long, proc long, aproc long")
    assert {r.k: r.classe for r in series.continuity(close, opened, ["k"]).collect()} == {1: "continuo", 2: "DESCONTINUIDADE", 3: "SALDO-SEM-CONTINUIDADE", 4: "encerrado"}


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k long, v string")
    assert [(r.k, r.lado) for r in integrity.table_differences(a, b).collect()] == [(2, "a")]
    h = lambda df: integrity.table_hash(df, ["k", "v"], []).first().hash
    assert h(b) == h(b.orderBy("k").repartition(3)) and h(a) != h(b)
    gates = integrity.union_all([integrity.gate("x", a, F.col("k") > 5), integrity.gate("y", a, F.col("k") > 1), integrity.gate("z", a, F.lit(True), verified=False)])
    assert {r.portao: (r.falhas, r.ok) for r in gates.collect()} == {"x": (0, True), "y": (2, False), "z": (None, None)}
    assert integrity.verdict(gates).first()[0] == "reprovado" and integrity.verdict(gates.where("portao <> 'y'")).first()[0] == "incompleto"
    assert integrity.only_adds(b, a, ["k", "v"]).count() == 0
    d = spark.createDataFrame([("S1", "operacional", True), ("S2", "experimental", True)], "regra string, situacao string, compoe boolean")
    assert integrity.published_rules(d, ["S1", "S2", "S3"]) == ["S2", "S3"]


def test_provenance(spark):
    rec = spark.createDataFrame([("u", 1), ("u", 2)], "coleta string, ordem int")
    resp = spark.createDataFrame([("u", 1, "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"), ("u", 2, "00")], "coleta string, ordem int, sha256 string")
    obj = spark.createDataFrame([("2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae", 3, bytearray(b"foo"))], "sha256 string, tamanho long, body binary")
    assert {r.ordem: r.integro for r in integrity.provenance(rec, resp, obj).collect()} == {1: True, 2: False}


def test_texts_and_dates(spark):
    df = spark.createDataFrame([("12.345.678/0001-90",), ("***123***",), ("123.456.789-01",), ("12345678000190",), ("***.123.***-**",), ("abc",), ("",), (None,)], "d string")
    assert [r.x for r in df.select(text.creditor_type(F.col("d")).alias("x")).collect()] == ["pessoa jurídica", "pessoa física", "pessoa física"] + ["não identificado"] * 5
    df = spark.createDataFrame([("52998224725",), ("529.982.247-25",), ("52998224724",), ("11111111111",), ("x",)], "d string")
    assert [r.x for r in df.select(text.valid_cpf(F.col("d")).alias("x")).collect()] == [True, True, False, False, False]
    names = [("12.345.678/0001-90 - ACME 123456789 x*123", None, "ACME [documento omitido] x[documento omitido]"), ("MARIA", "***123***", "[nome de pessoa física omitido]"), ("  ", None, None), (None, None, None), ("LOJA 12 DE 2024-10", "x", "LOJA 12 DE 2024-10"), ("A 12.345.678/0001-90 B", None, "A [documento omitido] B")]
    df = spark.createDataFrame(names, "n string, d string, want string")
    assert [r.x for r in df.select(text.public_name(F.col("n"), F.col("d")).alias("x")).collect()] == [w for _, _, w in names]
    df = spark.createDataFrame([("1.1",), ("1.0000000001",), ("10.00000000004",), ("1e2",), ("1e-3",), ("-0.5",), ("7.2500",), ("1.00000000000000000001",), ("x",), (None,)], "d string")
    assert [r.x for r in df.select(money.exact_cents(F.col("d")).alias("x")).collect()] == [110, None, None, 10000, None, -50, 725, None, None, None]
    df = spark.createDataFrame([("1",), ("10",), ("010",), ("28",), ("29",), ("0",), ("x",), (None,)], "d string")
    assert [r.x for r in df.select(text.function_name(F.col("d")).alias("x")).collect()] == ["Legislativa", "Saúde", None, "Encargos Especiais", None, None, None, None]
    assert df.select(text.full_document(F.lit("12345678000190"))).first()[0] == "12.345.678/0001-90"
    df = spark.createDataFrame([("2024-03-05",), ("2024-03-05T10:00:00",), ("2024-03-05T10:00:00Z",), ("bad",)], "d string")
    got = [r.x for r in df.select(F.date_format(dates.canonical_instant(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()]
    assert got == ["2024-03-06 02:59:59", "2024-03-05 13:00:00", "2024-03-05 10:00:00", None]
    row = df.select(dates.bimester(F.lit("2024-03-05").cast("date")), dates.bimester_end(F.lit(2024), F.lit(1)), dates.month_end(F.lit(2024), F.lit("Fevereiro")), dates.month_end(F.lit(2024), F.lit("x"))).first()
    assert [str(x) for x in row] == ["2", "2024-02-29", "2024-02-29", "None"]
