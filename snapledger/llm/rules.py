"""Operator 12, quality rules as a short-circuit cascade. Built from DataFrame functions only.

A rule is a measure of a text and the condition under which it rejects. On a sample, each rule is timed and its rejections are counted; rules then run in order of
rejections per cost, and a text that one rejects is asked no further. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: White space of the contracts, as characters and as a class; symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
SEED, SAMPLE = 12, 2000
#: Bits of a window's place, and their mask.
_PLACE_BITS, _PLACE = 31, (1 << 31) - 1
#: Times that a rule is timed on the sample; the least counts.
RUNS = 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def _letters(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.translate(text, SPACES, ""))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def repeat_words(words: Column) -> Column:
    """Words that lie in windows of three which the array has twice or more.

    A window is first a number: 33 bits of its hash above its place. In sorted numbers, windows that share a hash are neighbours; those few are then compared by their words, sorted
    in their turn, so that nothing depends on the hash. The places in order of those that do repeat tell how many words they cover, at most three each.
    """
    number = lambda h, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
    numbers = lambda h: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: number(h, i)))
    near = lambda x, y: F.shiftright(x.bitwiseXOR(y), _PLACE_BITS) == 0
    shared = lambda s: F.filter(s, lambda x, k: near(x, F.get(s, k - 1)) | near(x, F.get(s, k + 1)))
    window = lambda w, i: F.struct(F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    windows = lambda w, c: F.transform(F.transform(c, lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")), lambda i: window(w, i))
    same = lambda s: F.filter(s, lambda x, k: (x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"]))
    places = lambda w, c: F.sort_array(F.transform(_with(F.sort_array(windows(w, c)), same), lambda x: x["i"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = lambda p: F.aggregate(p, none, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    zero = F.lit(0).cast("long")
    candidates = lambda w: _with(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _with(numbers(h), shared))
    return F.when(F.size(words) < 3, zero).otherwise(_with(words, lambda w: _with(candidates(w), lambda c: F.when(F.size(c) == 0, zero).otherwise(covered(places(w, c))))))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Measures by name: a count from the text, its words and its lines.
MEASURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "n_words": lambda text, words, lines: F.size(words),
    "word_chars": lambda text, words, lines: _letters(text),
    "n_symbols": lambda text, words, lines: F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
    "n_dup_lines": lambda text, words, lines: F.size(lines) - F.size(F.array_distinct(lines)),
    "n_repeat_words": lambda text, words, lines: repeat_words(words),
    "n_lines": lambda text, words, lines: F.size(lines),
    "n_bullets": lambda text, words, lines: F.size(F.filter(lines, lambda x: x.rlike(r"^ *[-*\u2022\u2023\u25AA\u25CF]"))),
    "n_ellipses": lambda text, words, lines: F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|\u2026) *\z"))),
    "n_wordless": lambda text, words, lines: F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")),
    "n_marks": lambda text, words, lines: F.length(text) - F.length(F.translate(text, "!?{}~^@", "")),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose measures, integers in the order named, meet the condition."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., Column]


#: The contract's base rules, then those of the method. Bounds are wide enough for prose of any of the languages, lists and code.
BASE = (Rule("few words", ("n_words",), lambda w: w < 50), Rule("repeated words", ("n_repeat_words", "n_words"), lambda r, w: 100 * r > 50 * w))
RULES = (
    *BASE,
    Rule("length of words", ("word_chars", "n_words"), lambda c, w: (c < 2 * w) | (c > 15 * w)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, w: 10 * s > 3 * w),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 5 * n),
    Rule("bullets", ("n_bullets", "n_lines"), lambda b, n: (n > 1) & (10 * b > 9 * n)),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda e, n: (n > 1) & (10 * e > 3 * n)),
    Rule("words without a letter", ("n_wordless", "n_words"), lambda x, w: 10 * x > 3 * w),
    Rule("marks", ("n_marks", "n_words"), lambda m, w: 10 * m > 5 * w),
)


@dataclass(frozen=True)
class Measured:
    """A rule on the sample: share of the texts that it rejects, and seconds that it takes for all of them."""

    rule: Rule
    rejected: float
    cost: float

    @property
    def worth(self) -> float:
        return self.rejected / self.cost


def _parts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs' columns in one struct, so that no name can clash, with text, words and lines beside it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text")).withColumns({"words": words_of(F.col("text")), "lines": _lines(F.col("text"))})


def _measure(name: str) -> Column:
    return MEASURES[name](F.col("text"), F.col("words"), F.col("lines")).cast("long")


def _condition(rule: Rule, known: Sequence[str] = ()) -> Column:
    """The rule's condition; a measure in known is a column already, another is worked out where the condition is asked."""
    values = F.struct(*[(F.col(m) if m in known else _measure(m)).alias(m) for m in rule.measures])
    return _with(values, lambda v: rule.rejects(*[v[m] for m in rule.measures]))


def order_rules(sample: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> list[Measured]:
    """Rules by rejections per cost, the best first, each timed and counted on the whole sample (a DataFrame that is cheap to read again).

    What reading the sample and splitting it takes is taken off. On an empty sample, or among rules that reject nothing, the cheapest come first.
    """
    parts = _parts(sample, text_col)

    def run(condition: Column) -> tuple[float, int, int]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            row = parts.agg(F.count_if(condition).alias("rejected"), F.count(F.lit(1)).alias("n"), F.sum(F.size("words") + F.size("lines"))).first()
            took.append(time.perf_counter() - began)
        return min(took), row["rejected"], row["n"]

    bare = run(F.lit(False))[0]
    found = []
    for rule in rules:
        seconds, rejected, n = run(_condition(rule))
        found.append(Measured(rule, rejected / max(n, 1), max(seconds - bare, 1e-4)))
    return sorted(found, key=lambda m: (-m.worth, m.cost))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: Sequence[str] = (), text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: row (its columns), the measures asked for, and failed: the first rule in order that rejects it, else null.

    Rules are ordered by what they do on about ``sample_rows`` rows; a rule is only worked out for what those before it let pass, as the branches of one CASE. Which rows are
    rejected doesn't depend on the sample or the order; which rule is named does.

    Null text counts as empty, so it has few words. Texts of any length are read whole; the words of one text, with some 250 bytes each, must fit a task. Repeated rows are
    judged alike, columns of any name stay in the struct. An empty table gives an empty table.
    """
    rows = docs.count()
    sample = checkpointed(docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(rows, 1)), SEED))
    order = [m.rule for m in order_rules(sample, rules)]
    parts = _parts(docs, text_col).select("row", "text", "words", "lines", *[_measure(m).alias(m) for m in measures])
    failed = F.lit(None).cast("string")
    for rule in reversed(order):
        failed = F.when(_condition(rule, measures), F.lit(rule.name)).otherwise(failed)
    return parts.select("row", *measures, failed.alias("failed"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their own columns, that no rule rejects; no measure is worked out for a row that an earlier rule has rejected. Odd rows as in ``judge``."""
    return judge(docs, rules, (), text_col, sample_rows).where("failed is null").select("row.*")


#: What the query returns: the contract's measures, whether a base rule rejects, and the cascade's verdict.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The verdict in SQL; the order of rules doesn't matter there.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 2]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*\x{2022}\x{2023}\x{25AA}\x{25CF}]'))) AS n_bullets,
 len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026}) *\z'))) AS n_ellipses, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_wordless, length(regexp_replace(t, '[^!?{}~^@]', '', 'g')) AS n_marks FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines
 OR (n_lines > 1 AND 10 * n_bullets > 9 * n_lines) OR (n_lines > 1 AND 10 * n_ellipses > 3 * n_lines) OR 10 * n_wordless > 3 * n_words OR 10 * n_marks > 5 * n_words) AS kept FROM b
"""
