"""Official statements: cells from positioned words, declarations from labelled items, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import exact_cents, text_cents
from .store import cut

# Column letters, what their labels begin with on a page, the starts of rows' labels, labels of a declaration, the form of a number.
LETTERS = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "L")
PAGE_LABELS = {"(a)": "a", "(b)": "b", "(c)": "c", "(d)": "d", "e=(a+b)": "e", "(f)": "f", "(g)": "g", "(h)": "h", "(i)": "i", "(j)": "j", "k=(f+g)": "k", "L=(e+k)": "L"}
ROW_LABELS = ("RESTOS A PAGAR (EXCETO", "PODER EXECUTIVO", "RESTOS A PAGAR (INTRA", "TOTAL (III)")
LEGISLATIVE = "PODER LEGISLATIVO"
BALANCE_LABELS = {"Saldo Total L": "L", "Saldo e": "e", "Saldo k": "k"}
LABELS_2016 = {
    "RPP e RPNP Liquidados em Exercícios Anteriores - Inscritos Em Exercícios Anteriores": "a",
    "RPP e RPNP Liquidados em Exercícios Anteriores - Inscritos Em 31 de Dezembro de 2015": "b",
    "RPP e RPNP Liquidados Em Exercícios Anteriores - Pagos": "c",
    "RPP e RPNP Liquidados Em Exercícios Anteriores - Cancelados": "d",
    "Saldo (a)": "e",
    "RPNP - Inscritos Em Exercícios Anteriores": "f",
    "RPNP - Inscritos Em 31 de Dezembro de 2015": "g",
    "RPNP - Liquidados": "h",
    "RPNP - Pagos": "i",
    "RPNP - Cancelados": "j",
    "Saldo (b)": "k",
    "Saldo Total (a+b)": "L",
}
MONTHS = ("JANEIRO", "FEVEREIRO", "MARÇO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO")
PERIOD = r"JANEIRO A ([A-ZÇ]+) (\d)\.(\d{3})"
NUMBER = r"^-?\d{1,3}(\.\d{3})*,\d{2}$|^-$"
# The layouts in the order in which they are tried, the words of the second's heads from left to right and between which heights, what its rows are called otherwise, and the period of the third.
LAYOUTS = ("rp-rreo-coordenadas/2", "rp-rreo-2016/1", "rp-rreo-siconfi/1")
HEADS_2016, HEADS_AT, SAME_HEAD = ("Em", "Em", "Pagos", "Cancelados", "Saldo", "Em", "Em", "Liquidados", "Pagos", "Cancelados", "Saldo", "Saldo"), (170, 200), 15
ROW_ALIASES, NO_DASH = {"EXECUTIVO": "PODER EXECUTIVO"}, ("rp-rreo-2016/1",)
PRINT_PERIOD = r"JANEIRO \S ([A-ZÇ]+) (\d{4}) / BIMESTRE"
#: Points by which words of one line may differ in height; a row's label begins left of LABEL_EDGE.
LINE_HEIGHT, LABEL_EDGE = 2.5, 200


def period_end(text: Column) -> Column:
    """Last day of the period that a page names, such as ``JANEIRO A ABRIL 2.024``; NULL if it names none."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(text, PERIOD, 1))
    year = F.concat(F.regexp_extract(text, PERIOD, 2), F.regexp_extract(text, PERIOD, 3)).try_cast("int")
    return F.when((month > 0) & year.isNotNull(), F.last_day(F.make_date(year, F.greatest(month, F.lit(1)).cast("int"), F.lit(1))))


def lines(words: DataFrame) -> DataFrame:
    """words (doc, page, x0, y0, x1, y1, text) with line, the height of the first number, from the top, within LINE_HEIGHT; words beside no number have none.

    Heights are told apart from a line's first number, not from word to word, so that lines don't drift together. A page's different heights are its own array.
    """
    far = lambda a, y: (F.size(a) == 0) | (F.try_element_at(a, F.lit(-1)) + LINE_HEIGHT <= y)
    heights = words.where(F.col("text").rlike(NUMBER)).groupBy("doc", "page").agg(F.array_sort(F.collect_set("y0")).alias("__y"))
    firsts = F.aggregate("__y", F.array().cast("array<double>"), lambda a, y: F.when(far(a, y), F.array_append(a, y)).otherwise(a))
    own = F.try_element_at(F.filter("__a", lambda a: F.abs(a - F.col("y0")) < LINE_HEIGHT), F.lit(1))
    return words.join(heights.select("doc", "page", firsts.alias("__a")), ["doc", "page"], "left").withColumn("line", own).drop("__a")


def cells(words: DataFrame) -> DataFrame:
    """(doc, linha, coluna, valor) of the statement's rows.

    A document gives cells only if it is one page with all twelve column labels. A row counts if it has twelve numbers, each strictly between the labels beside its own; other rows
    give no cells (a document is refused whole by validation, never filled in). A cell printed twice with two values refuses the document. Numbers are cents; ``-`` is zero.
    """
    single = words.groupBy("doc").agg(F.count_distinct("page").alias("n")).where("n = 1").select("doc")
    placed = lines(words.join(single, "doc", "left_semi")).withColumn("x", (F.col("x0") + F.col("x1")) / 2)
    return _table(placed, _labelled(placed)).drop("layout")


def _labelled(placed: DataFrame) -> DataFrame:
    """(doc, page, layout, coluna, x): columns by what their labels begin with."""
    letter = F.coalesce(*[F.when(F.col("text").startswith(k), v) for k, v in PAGE_LABELS.items()])
    return placed.withColumn("coluna", letter).where("coluna is not null").groupBy("doc", "page", "coluna").agg(F.min_by("x", F.struct("y0", "x0")).alias("x")).select("doc", "page", F.lit(LAYOUTS[0]).alias("layout"), "coluna", "x")


def _table(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, layout, linha, coluna, valor): cells of the rows that are whole under the columns of each layout."""
    page = ["doc", "page", "layout"]
    order = Window.partitionBy(*page).orderBy("x")
    heads = heads.withColumns({"pos": F.row_number().over(order), "low": F.lag("x").over(order), "high": F.lead("x").over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(*page))}).where(F.col("n") == len(LETTERS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    label = F.coalesce(*[F.when(F.col("t").startswith(n), n) for n in ROW_LABELS], *[F.when(F.col("t").startswith(n), to) for n, to in ROW_ALIASES.items()])
    beside = placed.where(F.col("line").isNotNull() & (F.col("x0") < LABEL_EDGE) & ~F.col("text").rlike(NUMBER))
    rows = beside.groupBy("doc", "page", "line").agg(text.alias("t")).withColumn("linha", label).where("linha is not null")
    line = Window.partitionBy(*page, "line")
    found = placed.where(F.col("text").rlike(NUMBER)).join(heads.select(*page).distinct(), ["doc", "page"]).where((F.col("text") != "-") | ~F.col("layout").isin(*NO_DASH))
    numbers = found.withColumns({"pos": F.row_number().over(line.orderBy("x")), "n": F.count(F.lit(1)).over(line)}).where(F.col("n") == len(LETTERS))
    met = numbers.join(rows.select("doc", "page", "line", "linha"), ["doc", "page", "line"]).join(heads.select(*page, "pos", "coluna", "low", "high"), [*page, "pos"])
    inside = (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    value = F.when(F.col("text") == "-", F.lit(0).cast("long")).otherwise(text_cents(F.col("text")))
    good = met.withColumn("__ok", F.count_if(inside).over(line) == len(LETTERS)).where("__ok").select("doc", "layout", "linha", "coluna", value.alias("valor")).distinct()
    twice = good.groupBy("doc", "layout", "linha", "coluna").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "layout")
    return good.join(twice, ["doc", "layout"], "left_anti")


def _in_order(placed: DataFrame) -> DataFrame:
    """(doc, page, layout, coluna, x): columns without labels, by the words of their heads, which from left to right must be exactly HEADS_2016; an ``Em`` beside one already met belongs to the same column."""
    top = placed.where(F.col("y0").between(*HEADS_AT) & F.col("text").isin(*set(HEADS_2016)))
    row = top.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("w"))
    beside = lambda seen, w: (w["text"] == "Em") & F.exists(seen, lambda s: (s["text"] == "Em") & (F.abs(s["x"] - w["x"]) < SAME_HEAD))
    kept = F.aggregate("w", F.array().cast("array<struct<x:double,text:string>>"), lambda seen, w: F.when(beside(seen, w), seen).otherwise(F.array_append(seen, w)))
    right = row.withColumn("w", kept).where(F.transform("w", lambda w: w["text"]) == F.array(*[F.lit(t) for t in HEADS_2016]))
    return right.select("doc", "page", F.posexplode("w").alias("i", "w")).select("doc", "page", F.lit(LAYOUTS[1]).alias("layout"), F.get(F.array(*[F.lit(c) for c in LETTERS]), F.col("i")).alias("coluna"), F.col("w.x").alias("x"))


def _in_pairs(placed: DataFrame) -> DataFrame:
    """(doc, page, layout, coluna, x): columns by labels in pieces, ``( a )`` or ``e =``, each where it stands first in reading order; formulas further right repeat letters."""
    order = Window.partitionBy("doc", "page").orderBy(F.bround("y0"), "x0")
    near = lambda other: F.abs(other["y0"] - F.col("y0")) < LINE_HEIGHT
    w = placed.withColumns({"antes": F.lag(F.struct("y0", "text")).over(order), "depois": F.lead(F.struct("y0", "text")).over(order)})
    bracketed = F.col("text").isin(*[c for c in LETTERS if c not in ("e", "k", "L")]) & (F.col("antes.text") == "(") & near(F.col("antes")) & (F.col("depois.text") == ")") & near(F.col("depois"))
    equated = F.col("text").isin("e", "k", "L") & (F.col("depois.text") == "=") & near(F.col("depois"))
    return w.where(bracketed | equated).groupBy("doc", "page", F.col("text").alias("coluna")).agg(F.min_by("x", F.struct(F.bround("y0"), "x0")).alias("x")).select("doc", "page", F.lit(LAYOUTS[2]).alias("layout"), "coluna", "x")


def period_of(text: Column, layout: Column) -> Column:
    """Last day of the period that a page of a layout names: ``JANEIRO A ABRIL 2.016``, or in the print of a declaration ``JANEIRO À ABRIL 2018 / BIMESTRE``."""
    month, year = F.regexp_extract(text, PRINT_PERIOD, 1), F.regexp_extract(text, PRINT_PERIOD, 2).try_cast("int")
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    printed = F.when((place > 0) & year.isNotNull(), F.last_day(F.make_date(year, F.greatest(place, F.lit(1)).cast("int"), F.lit(1))))
    return F.when(layout == LAYOUTS[2], printed).otherwise(period_end(text))


def read_layouts(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, layout, fim) with why a document is refused, and (doc, layout, linha, coluna, valor) of those that aren't.

    The layouts are tried in order, for all documents at once; the first whose cells hold by the statement's own identities, and whose period can be read, is the document's. A document
    that none reads is refused whole with the reason of the layout that came furthest: pages, columns, rows, the broken rule, or the period. Nothing is ever read in part.
    """
    pages = words.groupBy("doc").agg(F.count_distinct("page").alias("paginas"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("y0"), "x0", "text"))), lambda w: w["text"]), " ").alias("texto"))
    placed = cut(lines(words.join(pages.where("paginas = 1").select("doc"), "doc", "left_semi")).withColumn("x", (F.col("x0") + F.col("x1")) / 2))
    heads = _labelled(placed).unionByName(_in_order(placed)).unionByName(_in_pairs(placed))
    whole = heads.groupBy("doc", "layout").agg(F.count_distinct("coluna").alias("n")).where(F.col("n") == len(LETTERS)).select("doc", "layout")
    found = cut(_table(placed, heads))
    judged = validate(found, ["doc", "layout"]).withColumn("lida", F.lit(True))
    tried = whole.join(judged, ["doc", "layout"], "left").join(pages.select("doc", "texto"), "doc").withColumn("fim", period_of(F.col("texto"), F.col("layout")))
    why = F.when(F.col("lida").isNull(), "linhas não lidas").when(F.col("violacao").isNotNull(), F.col("violacao")).when(F.col("fim").isNull(), "período não encontrado")
    far = F.when(F.col("lida").isNull(), 1).when(F.col("violacao").isNotNull(), 2).when(F.col("fim").isNull(), 3).otherwise(4)
    place = F.array_position(F.array(*[F.lit(n) for n in LAYOUTS]), F.col("layout"))
    best = tried.groupBy("doc").agg(F.max_by(F.struct("layout", F.date_format("fim", "yyyy-MM-dd").alias("fim"), why.alias("motivo")), F.struct(far, -place)).alias("b"))
    told = pages.join(best, "doc", "left").select("doc", F.when(F.col("b.motivo").isNull(), F.col("b.layout")).alias("layout"), F.when(F.col("b.motivo").isNull(), F.col("b.fim")).alias("fim"), F.when(F.col("paginas") != 1, F.concat(F.col("paginas").cast("string"), F.lit(" páginas"))).when(F.col("b").isNull(), "colunas não encontradas").otherwise(F.col("b.motivo")).alias("motivo"))
    told = cut(told)
    return told, found.join(told.where("motivo is null").select("doc", "layout"), ["doc", "layout"])


def twelve_after(tokens: DataFrame, mark: str = "TOTAL (III)") -> DataFrame:
    """(doc, coluna, valor): the first twelve numbers after a mark in a document's text, where the identities close; else no rows."""
    after = F.substring_index("text", mark, -1)
    numbers = F.slice(F.filter(F.split(after, r"\s+"), lambda t: t.rlike(NUMBER)), 1, len(LETTERS))
    rows = tokens.where(F.col("text").contains(mark)).select("doc", numbers.alias("n")).where(F.size("n") == len(LETTERS))
    each = rows.select("doc", F.posexplode("n").alias("i", "t")).select("doc", F.element_at(F.array(*[F.lit(x) for x in LETTERS]), F.col("i") + 1).alias("coluna"), F.when(F.col("t") == "-", F.lit(0).cast("long")).otherwise(text_cents(F.col("t"))).alias("valor"))
    return each.join(closes(wide(each, ["doc"]), ["doc"]).where("fecha").select("doc"), "doc", "left_semi")


def wide(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).pivot("coluna", list(LETTERS)).agg(F.max("valor"))


def closes(statement: DataFrame, by: list[str]) -> DataFrame:
    """by and whether e, k and L follow from the other columns (absent ones count 0); false if nothing is there."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    ok = (c("e") == c("a") + c("b") - c("c") - c("d")) & (c("k") == c("f") + c("g") - c("i") - c("j")) & (c("L") == c("e") + c("k"))
    return statement.select(*by, (ok & F.coalesce(*[F.col(x) for x in LETTERS]).isNotNull()).alias("fecha"))


def column_of(label: Column) -> Column:
    """The column letter of a declaration's label, NULL if it has none: a label of 2016, a balance, or a letter in brackets at the end."""
    exact = [F.when(label == k, v) for k, v in LABELS_2016.items()]
    start = [F.when(label.startswith(k), v) for k, v in BALANCE_LABELS.items()]
    return F.coalesce(*exact, *start, F.nullif(F.regexp_extract(label, r"\(([a-j])\)\s*$", 1), F.lit("")))


def row_of(account: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(account).startswith(n), n) for n in (*ROW_LABELS, LEGISLATIVE)])


def declaration(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, linha, coluna, valor, situacao) of a declaration's items (by, coluna: label text, conta: account, valor: decimal or its text).

    A cell that occurs twice with different values, or with more than two decimals, refuses its row; an absent cell is zero only where the row's identities close
    with zero in its place. Rows that don't close keep their cells and are marked.
    """
    value = exact_cents(F.col("valor"))
    cell = items.select(*by, row_of(F.col("conta")).alias("linha"), column_of(F.col("coluna")).alias("coluna"), value.alias("valor")).where("linha is not null and coluna is not null")
    key = [*by, "linha"]
    one = cell.groupBy(*key, "coluna").agg(F.count_distinct("valor").alias("n"), F.count_if(F.col("valor").isNull()).alias("bad"), F.max("valor").alias("valor"))
    bad = one.groupBy(*key).agg((F.count_if((F.col("n") > 1) | (F.col("bad") > 0)) > 0).alias("bad"))
    table = wide(one, key).join(bad, key)
    closed = closes(table, key)
    kind = F.when(F.col("bad"), "recusada").when(F.col("fecha"), "completa").otherwise("não fecha")
    full = table.join(closed, key).withColumn("situacao", kind).unpivot([*key, "situacao"], list(LETTERS), "coluna", "valor")
    return full.withColumn("valor", F.when(F.col("situacao") == "completa", F.coalesce("valor", F.lit(0))).when(F.col("situacao") == "recusada", None).otherwise(F.col("valor")).cast("long"))


def validate(found: DataFrame, by: list[str]) -> DataFrame:
    """by and the first broken rule of a statement's cells (by, linha, coluna, valor), NULL if it holds: TOTAL and (I) are there, every row's identities, TOTAL = (I) + (II)."""
    first, third, total = ROW_LABELS[0], ROW_LABELS[2], ROW_LABELS[3]
    by_row = closes(wide(found, [*by, "linha"]), [*by, "linha"])
    rows = by_row.groupBy(*by).agg(F.bool_and("fecha").alias("fecha"), F.count_if(F.col("linha") == first).alias("i"), F.count_if(F.col("linha") == total).alias("t"))
    at = lambda n: F.coalesce(F.max(F.when(F.col("linha") == n, F.col("valor"))), F.lit(0))
    sums = found.groupBy(*by, "coluna").agg((at(first) + at(third) == at(total)).alias("ok")).groupBy(*by).agg(F.bool_and("ok").alias("soma"))
    rule = F.when(F.col("t") == 0, "sem TOTAL").when(F.col("i") == 0, "sem linha (I)").when(~F.col("fecha"), "identidade").when(~F.col("soma"), "TOTAL difere de (I) + (II)")
    return rows.join(sums, by).select(*by, rule.alias("violacao"))


def column_groups(table: DataFrame) -> DataFrame:
    """Inscriptions, payments, cancellations and balances of a wide statement; NULL where a member is absent."""
    c = F.col
    return table.withColumns({"inscritos": c("a") + c("b") + c("f") + c("g"), "pagos": c("c") + c("i"), "cancelados": c("d") + c("j"), "saldo": c("e") + c("k")})


def legislative_row(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the legislative power that a declaration leaves out: zero, only where (I) equals the executive in every column; a wide table's rows else unchanged."""
    first, executive = ROW_LABELS[0], ROW_LABELS[1]
    cell = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in LETTERS])
    at = lambda n: F.max(F.when(F.col("linha") == n, cell))
    found = table.groupBy(*by).agg(at(first).alias("i"), at(executive).alias("e"), F.bool_or(F.col("linha") == LEGISLATIVE).alias("there"))
    missing = found.where(~F.col("there") & (F.col("i") == F.col("e")))
    return table.unionByName(missing.select(*by, F.lit(LEGISLATIVE).alias("linha"), *[F.lit(0).cast("long").alias(c) for c in LETTERS]))


# What a delivery's status stands for.
DELIVERIES = {"HO": "homologada", "RE": "retificada"}


def deliveries(items: DataFrame, period: Column) -> DataFrame:
    """Deliveries of the bimestral report of a period, with what their status stands for (the code itself where it isn't known)."""
    known = F.create_map(*[F.lit(x) for kv in DELIVERIES.items() for x in kv])
    mine = items.where(F.col("entregavel").startswith("Relatório Resumido") & (F.col("periodicidade") == "B") & (F.col("periodo") == period))
    return mine.withColumn("situacao", F.coalesce(F.try_element_at(known, F.col("status_relatorio")), F.col("status_relatorio")))
