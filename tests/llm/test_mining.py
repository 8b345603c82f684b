"""Collocations, quality rules and clusters against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from snapledger.llm import clustering, collocations, rules

TEXTS = "doc_id long, text string, lang string, rep long, n long, word string, row string, failed string, words string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, x, 7, 7, "w", "r", "f", "w") for i, (t, x) in enumerate(rows)], TEXTS).repartition(3)


# 11 collocations


def brute_collocations(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in found.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), a, left, right, n[lang], score))
    out.sort()
    rank, ranked = Counter(), set()
    for lang, _, _, phrase, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.add((lang, rank[lang], phrase.decode(), *rest))
    return ranked


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "a", "of", "é", "ß", "x1", "big", "cat", "\x01", "中文", "New", "york", "city", "hall"]
    rows = [("".join(rng.choice(words[: rng.choice((4, 9, 15))]) + rng.choice((" ", " ", " ", "\t ", ". ", "\n", "new york city hall ")) for _ in range(rng.randrange(60))), rng.choice(("en", "fr", None, "und"))) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), (" \t.,;", "en"), ("to be or not to be " * 900, "en"), ("never " * 700, "fr"), ("z " * 3, "")]


@pytest.mark.parametrize(("seed", "block", "window", "ranked"), [(1, 1 << 22, 4 << 20, 10**6), (2, 64, 4 << 20, 40), (3, 500, 100, 1)])
def test_collocations_by_brute_force(spark, monkeypatch, seed, block, window, ranked):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "WINDOW_BYTES", window)
    rows = some_texts(seed)
    if ranked == 1:
        rows = [x for x in rows if len(x[0] or "") < 2000]
    monkeypatch.setattr(collocations, "RANKED", max(ranked, 40))
    out = collocations.collocations(texts(spark, rows), least=5, top=20)
    assert {tuple(r) for r in out.collect()} == brute_collocations(rows, 5, 20)


def test_blocks_cut_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 50)
    window = collocations.tokens
    monkeypatch.setattr(collocations, "tokens", lambda t: (w[k : k + 7] for w in window(t) for k in range(0, len(w), 7)))
    rows = [("to be or not to be that is " * 300, "en"), ("a b c " * 200, None)]
    assert {tuple(r) for r in collocations.collocations(texts(spark, rows), least=5, top=50).collect()} == brute_collocations(rows, 5, 50)


def test_lists_of_a_block():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        positions = np.sort(rng.choice(2000, n, replace=False)).astype(np.int32)
        lists = rng.integers(0, 5, n).astype(np.int32)
        order = np.lexsort((positions, lists))
        have, own, first, last = collocations.extend(positions[order], lists[order], 5)
        at = dict(zip(positions.tolist(), lists.tolist(), strict=True))
        want = sorted((at[p], at[p + 1], p) for p in at if p + 1 in at)
        assert [(first[k], last[k], p) for p, k in zip(have, own, strict=True)] == want
        values = rng.integers(-(2**31), 2**31, n).astype(np.int32)
        assert (collocations.unpack(collocations.pack(values)) == values).all()


def test_rare_phrases_take_few_bytes(spark, monkeypatch, tmp_path):
    for name, value in (("BLOCK", 100_000), ("GROUP", 100_000), ("PARTS", 4)):
        monkeypatch.setattr(collocations, name, value, raising=False)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = [(" ".join(rng.choices(words, k=1000)), "en") for _ in range(300)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3).persist()
    docs.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    tables, _ = collocations.frequent_phrases(docs, str(tmp_path / "phrases"))
    assert tables[1].count() == 0
    assert written() - before < 10 * 300_000
    docs.unpersist()


def test_counts_of_dealt_phrases(monkeypatch):
    monkeypatch.setattr(collocations, "DEALT", 7)
    rng = np.random.default_rng(4)
    want, sent = {}, []
    for group in (3, 1, 9):
        key = np.unique(rng.integers(0, 150, 90))
        a, b, n = key // 12 + (1 << 50), key % 12 + (1 << 40), rng.integers(0, 9, len(key))
        for i, x in enumerate(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)):
            want.setdefault(x[:2], []).append((group, i, x[2]))
        sent += [x for batch in collocations._dealt(group, a, b, n, 5) for x in batch.to_pylist()]
    sent.sort(key=lambda x: x["part"])
    assert {x["part"] for x in sent} == set(range(5))
    batches = [pa.RecordBatch.from_pylist(sent[k : k + 4], pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("data", pa.binary())])) for k in range(0, len(sent), 4)]
    got = [x for batch in collocations._counted(9)(iter(batches)) for x in batch.to_pylist()]
    rep = lambda x: min((g << collocations.GROUP_BITS) + i for g, i, _ in x)
    frequent = {p: x for p, x in want.items() if sum(n for _, _, n in x) >= 9}
    assert 0 < len(frequent) < len(want)
    assert sorted((x["gid"], x["f"], x["a"], x["b"]) for x in got if x["data"] is None) == sorted((rep(x), sum(n for _, _, n in x), *p) for p, x in frequent.items())
    lists = [(x["grp"], *y) for x in got if x["data"] is not None for y in collocations.unpack_rows(x["data"], 2, 1).T.tolist()]
    assert sorted(lists) == sorted((g, i, rep(x)) for x in frequent.values() for g, i, _ in x)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(texts(spark, [(None, None), ("", "en"), ("a b", "en")])).count() == 0
    assert collocations.collocations(spark.createDataFrame([], TEXTS)).count() == 0


# 12 quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
    wordless = sum(not any(c.isalpha() for c in w) for w in words)
    n, chars, symbols, dup, repeat = counts
    bullets, dots = sum(x.lstrip(" ")[:1] in "-*•‣▪●" and x.strip(" ") != "" for x in lines), sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    base = n < 50 or 100 * repeat > 50 * n
    bad = base or chars < 2 * n or chars > 15 * n or 10 * symbols > 3 * n or 2 * dup > len(lines) or (len(lines) > 1 and (10 * bullets > 9 * len(lines) or 10 * dots > 3 * len(lines))) or 10 * wordless > 3 * n or 10 * sum(c in "!?{}~^@" for c in text) > 5 * n
    return (*counts, not bad)


def rule_texts():
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghé") for _ in range(k))
    prose = [" ".join(word(rng.randrange(2, 9)) for _ in range(n)) for n in (49, 50, 51, 200, 2000)]
    lines = "\n".join(f"- {word(5)} {word(4)} {word(6)}" for _ in range(40))
    return [
        *prose, None, "", " \n\t\x0b", "a a a a", "a b", "a b c", "a b c a b c", "\n".join([prose[1]] * 4), prose[3] + " # " * 70, lines, lines.replace("- ", " "), "\n".join(f"{word(6)} {word(7)} ..." for _ in range(40)), "\n".join(f"{word(6)} {word(7)} … " for _ in range(40)),
        " ".join("1234" for _ in range(80)), " ".join(f"{i} 12" for i in range(80)), prose[2] + "!" * 90, " ".join(word(1) + "" for _ in range(90)), " ".join(word(20) for _ in range(90)), "x y z " * 30 + prose[4], "中文 漢字 " + prose[3], "lorem ipsum dolor " * 20_000, prose[3], prose[3],
    ]


def test_rules_by_brute_force(spark):
    every = [(t, "en") for t in rule_texts()]
    docs = texts(spark, every)
    want = sorted((i, *brute_counts(t)) for i, (t, _) in enumerate(every))
    out = rules.judge(docs, measures=rules.COUNTS).selectExpr("row.doc_id", *rules.COUNTS, "failed is null as kept")
    assert sorted(map(tuple, out.collect())) == want
    assert {w[-1] for w in want} == {True, False}
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[-1]]
    assert kept.first().failed == "f"


def test_windows_that_share_a_hash(spark, monkeypatch):
    # all windows are neighbours then, and are told apart by their words
    monkeypatch.setattr(rules, "_PLACE_BITS", 63)
    every = [(t, "en") for t in rule_texts() if len(t or "") < 20_000]
    out = rules.judge(texts(spark, every), measures=("n_repeat_words",)).selectExpr("row.doc_id", "n_repeat_words")
    assert sorted(map(tuple, out.collect())) == [(i, brute_counts(t)[4]) for i, (t, _) in enumerate(every)]


def test_rules_run_in_order_of_worth(spark):
    docs = texts(spark, [(t, "en") for t in rule_texts()]).cache()
    order = rules.order_rules(docs)
    assert {m.rule.name for m in order} == {r.name for r in rules.RULES} and all(a.worth >= b.worth for a, b in zip(order, order[1:], strict=False))
    first = next(m for m in order if m.rule.name == "few words")
    assert first.rejected == sum(brute_counts(t)[0] < 50 for t in rule_texts()) / len(rule_texts())
    verdict = lambda r: sorted((x.id, x.failed is None) for x in rules.judge(docs, r).selectExpr("row.doc_id as id", "failed").collect())
    assert verdict(rules.RULES) == verdict(rules.RULES[::-1])
    # a rule is not asked about what an earlier one rejects
    strict = rules.Rule("raises", ("n_words",), lambda w: rules.F.when(w < 50, rules.F.raise_error(rules.F.lit("asked"))).otherwise(False))
    monkey = [rules.Measured(r, 1.0, 1.0) for r in (rules.BASE[0], strict)]
    found, rules.order_rules = rules.order_rules, lambda *a: monkey
    try:
        assert rules.judge(docs, [m.rule for m in monkey]).where("failed is null").count() > 0
    finally:
        rules.order_rules = found


def test_rules_on_nothing(spark):
    none = spark.createDataFrame([], TEXTS)
    assert rules.judge(none, measures=rules.COUNTS).count() == 0 and rules.keep_good(none).columns == none.columns


# 13 clusters


def brute_clusters(rows, clusters, rounds, parts, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == parts and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            kept.append((i, [math.floor(x * scale) for x in v]))
    sha = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((sha(i), v) for i, v in kept))[:clusters]]
    far = lambda v, k: sum((a - b) ** 2 for a, b in zip(v, c[k], strict=True))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, k), k))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v) == k] for k in range(len(c))]
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c[k] for k, o in enumerate(own)]
    fits = lambda n: n if n < 2**63 else None
    at = [(i, near(v), far(v, near(v))) for i, v in kept]
    return [(i, k, fits(d), fits(sum(y for _, x, y in at if x == k)), fits(sum(y for *_, y in at)), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in at]


VECTORS = "vec_id long, embedding array<double>, label int, cluster int, x string, id string"
plain = lambda rows: sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("size", [1.0, 1e3, 1e7, 1e15, 1e200])
def test_clusters_by_brute_force(spark, size):
    rng = random.Random(int(math.log10(size)))
    rows = [(i, [rng.gauss(rng.choice((-1, 0, 1)), 0.2) * size for _ in range(4)]) for i in range(120)]
    rows += [(1, [size, 0.0, -size, 0.5]), (1, [size, 0.0, -size, 0.5]), (None, [0.0] * 4), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0] * 5), (207, [1e308] * 4), (208, [-0.0001] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, "x", "i") for i, v in rows], VECTORS).repartition(5)
    assert plain(clustering.cluster(df, clusters=5, rounds=4, parts=4).collect()) == plain(brute_clusters(rows, 5, 4, 4))


def test_clusters_ties_and_few(spark):
    same = [(i, [1.0, 1.0]) for i in range(6)]
    for rows in (same, same[:2], [(i, [float(i % 2), 0.0]) for i in range(9)]):
        df = spark.createDataFrame([(i, v, 1, 2, "x", "i") for i, v in rows], VECTORS)
        assert plain(clustering.cluster(df, clusters=4, rounds=3, parts=2).collect()) == plain(brute_clusters(rows, 4, 3, 2))
    assert clustering.cluster(spark.createDataFrame([], VECTORS)).count() == 0


def test_distances_are_exact_in_every_form():
    rng = random.Random(4)
    kinds = set()
    for bits in (10, 24, 26, 29, 31, 40, 62, 80):
        rows = [[rng.randrange(-(2**bits), 2**bits) for _ in range(8)] for _ in range(20)]
        kind, data = clustering.to_block(np.array(rows, np.float64)) if bits < 53 else ("<f8", np.array(rows, np.float64).tobytes())
        x = clustering.from_block(kind, data, 8)
        c = [[int(v) for v in r] for r in x[:3]]
        far = clustering.distances(x, c)
        kinds.add(str(far.dtype))
        assert [[int(d) for d in r] for r in far] == [[sum((int(a) - b) ** 2 for a, b in zip(r, k, strict=True)) for k in c] for r in x]
    assert kinds == {"float64", "int64", "object"}


# columns by the names that operators use


def test_columns_of_any_name_pass_through(spark):
    import itertools

    from snapledger.llm import exact_dedup, mixing, sharding, simhash

    names = ["__row", "__size", "__src", "__order", "__bucket", "__digest", "__copy", "__coin", "__class", "__salt", "__key", "__id", "__at", "kept_0", "row", "__b", "__n"]
    rows = [(i, f"text {i % 4} one two three four five six", f"s{i % 2}", *[f"{n} {i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    own = {tuple(r) for r in docs.collect()}
    for out in (exact_dedup.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs), mixing.emit(docs), sharding.external_shuffle(docs, shards=2, bucket_rows=4).drop("shard", "slot")):
        assert out.columns == docs.columns
        found = [tuple(r) for r in out.collect()]
        assert found and set(found) <= own
    assert len(list(itertools.chain(found))) == 12
