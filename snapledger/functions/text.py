"""Creditor types, masks, codes, canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Kinds of creditors, and what stands for what isn't shown.
CREDITOR_TYPES = ("pessoa jurídica", "pessoa física", "não identificado")
HIDDEN_DOCUMENT, HIDDEN_PERSON, RESTRICTED = "[documento omitido]", "[nome de pessoa física omitido]", "[restrito]"
#: A run that may be a document: digits, dots, slashes, hyphens and asterisks, with a digit or an asterisk at both ends.
DOCUMENT_RUN = r"[\d*][\d.*/-]*[\d*]|\d"
#: A document before a name.
DOCUMENT_LEAD = r"^\s*[\d.*/-]{8,}\s*-\s*"


def creditor_type(document: Column) -> Column:
    """Company by a formatted number, person by a masked number or any eleven digits, else not identified; nothing in between is guessed."""
    text = F.coalesce(document, F.lit(""))
    company, person, unknown = CREDITOR_TYPES
    return F.when(text.rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\z"), company).when(text.rlike(r"^\*+\d{3}\*+\z") | (F.length(F.regexp_replace(text, r"\D", "")) == 11), person).otherwise(unknown)


def full_document(text: Column) -> Column:
    """14 digits written as ``00.000.000/0000-00``, NULL otherwise."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) == 14, F.regexp_replace(digits, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))


def mask_tokens(text: Column, digits: int = 8) -> Column:
    """text, with every space-separated token of at least so many digits (or three digits beside asterisks) replaced by ``***``."""
    count = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    hidden = lambda t: (count(t) >= digits) | ((count(t) >= 3) & t.contains("*"))
    return F.array_join(F.transform(F.split(text, " ", -1), lambda t: F.when(hidden(t), "***").otherwise(t)), " ")


def hide_documents(text: Column) -> Column:
    """text with every run of at least eight digits, or with an asterisk and three digits, replaced; what lies between runs stays as it is."""
    digits = lambda t: F.length(F.regexp_replace(t, r"\D", ""))
    runs = F.transform(F.regexp_extract_all(text, F.lit(DOCUMENT_RUN), 0), lambda t: F.when((digits(t) >= 8) | (t.contains("*") & (digits(t) >= 3)), HIDDEN_DOCUMENT).otherwise(t))
    gaps = F.split(text, DOCUMENT_RUN, -1)
    return F.array_join(F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")


def public_name(name: Column, document: Column) -> Column:
    """A creditor's name as the public may see it: no person's name, no document before or in a company's; NULL where nothing is left."""
    shown = F.trim(hide_documents(F.regexp_replace(name, DOCUMENT_LEAD, "")))
    return F.when(creditor_type(document) == CREDITOR_TYPES[1], HIDDEN_PERSON).otherwise(F.nullif(shown, F.lit("")))


def valid_cpf(text: Column) -> Column:
    """Whether 11 digits have the right two check digits and aren't all alike."""
    d = F.transform(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda c: c.try_cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())

    def check(n: int) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.try_element_at(d, i) * (n + 2 - i))
        return (total * 10) % 11 % 10 == F.try_element_at(d, F.lit(n + 1))

    return F.coalesce((F.size(d) == 11) & (F.size(F.array_distinct(d)) > 1) & check(9) & check(10), F.lit(False))


# A full and a masked taxpayer's number, and the masked ones of made examples.
CPF_FULL, CPF_MASKED = r"(?<![\d.])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\d.])", r"\*{3,4}\d{3}\*{3,4}"
CPF_EXAMPLES = ("****123****", "***456***")


def personal_numbers(text: Column) -> Column:
    """Taxpayers' numbers in a text: array of struct(tipo, numero, posicao), full ones with right check digits and masked ones that aren't made examples; posicao counts the candidates of a kind from 1."""
    found = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda n, i: F.struct(n.alias("numero"), (i + 1).alias("posicao")))
    kind = lambda name, x: F.struct(F.lit(name).alias("tipo"), x["numero"].alias("numero"), x["posicao"].alias("posicao"))
    full = F.transform(F.filter(found(CPF_FULL), lambda x: valid_cpf(x["numero"])), lambda x: kind("completo", x))
    masked = F.transform(F.filter(found(CPF_MASKED), lambda x: ~x["numero"].isin(*CPF_EXAMPLES)), lambda x: kind("mascarado", x))
    return F.concat(full, masked)


def personal_data_in(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, coluna, tipo, numero, posicao) of the taxpayers' numbers in every text column of a table, in one pass; columns of other types are not looked at, NULL texts have none."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string" and f.name not in key]
    each = F.array(*[F.struct(F.lit(c).alias("coluna"), personal_numbers(F.col(f"`{c}`")).alias("n")) for c in texts])
    return rows.select(*key, F.explode(each).alias("c")).select(*key, "c.coluna", F.explode("c.n").alias("n")).select(*key, "coluna", "n.tipo", "n.numero", "n.posicao")


# Names of the budget functions 01 to 28.
FUNCTIONS = (
    "Legislativa", "Judiciária", "Essencial à Justiça", "Administração", "Defesa Nacional", "Segurança Pública", "Relações Exteriores", "Assistência Social", "Previdência Social", "Saúde", "Trabalho", "Educação", "Cultura",
    "Direitos da Cidadania", "Urbanismo", "Habitação", "Saneamento", "Gestão Ambiental", "Ciência e Tecnologia", "Agricultura", "Organização Agrária", "Indústria", "Comércio e Serviços", "Comunicações", "Energia", "Transporte",
    "Desporto e Lazer", "Encargos Especiais",
)


def padded_code(code: Column, width: int) -> Column:
    """A code with zeros before it; one that is longer stays as it is."""
    text = code.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def function_name(code: Column) -> Column:
    """Name of a budget function by its code, with or without a zero before it; NULL for any other code."""
    number = F.when(padded_code(code, 2).rlike(r"^\d{2}\z"), padded_code(code, 2).try_cast("int"))
    return F.try_element_at(F.array(*[F.lit(n) for n in FUNCTIONS]), F.nullif(number, F.lit(0)))


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns' texts in the given order; NULL is told apart from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]), 256)


def set_hash(hash_column: str) -> Column:
    """Hash of a group of row hashes, whatever their order or partitioning: an aggregate of the count and of the sums of four parts
    of 48 bits, so that no group is gathered."""
    part = lambda i: F.sum(F.conv(F.substring(F.col(hash_column), 1 + 12 * i, 12), 16, 10).cast("decimal(18,0)"))
    return F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[part(i).cast("decimal(38,0)").cast("string") for i in range(4)]), 256)


def private_path(path: Column) -> Column:
    return path.startswith("privado/") | path.contains("/privado/") | path.endswith(".private")
