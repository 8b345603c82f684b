"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import tempfile
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from snapledger.llm import common, exact_dedup, fingerprints, language, mixing, packing, quality, queries, secrets, sharding, simhash, token_counts, tokens
from snapledger.llm.common import components
from snapledger.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, __x string"
LONG = "lorem ipsum dolor " * 30_000
ROWS = [
    (1, "a b c d e f", "en", "s1", 11, 0, 0, 0, "x"), (2, None, None, None, None, None, None, None, None), (3, "", "en", "s1", 0, 0, 0, 0, "x"), (4, "a  b\tc d\ne f", "en", "s2", 12, 0, 0, 0, "x"),
    (5, LONG, "fr", "s2", len(LONG), 0, 0, 0, "x"), (6, "a b c d e f", "en", None, 11, 0, 0, 0, "x"), (6, "a b c d e f", "en", None, 11, 0, 0, 0, "x"), (None, "nobody has this id", None, "s3", 18, 0, 0, 0, "x"),
    (8, "éàü ñ 中文 ßẞ", "de", "s3", 11, 0, 0, 0, "x"), (9, " \t\n", "en", "s3", 3, 0, 0, 0, "x"), (10, 'key token = "0123456789abcdef0123456789abcdef01234567" end', "en", "s4", 58, 0, 0, 0, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def got(df):
    return [r.asDict() for r in df.collect()]


def new_folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/out"


# 1 sharding


def test_shuffle_laws(spark):
    out = queries.op1_shard(spark, SF).toPandas()
    docs = documents().set_index("doc_id").text
    assert sorted(out.doc_id) == sorted(docs.index)
    sizes = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    for r in out.itertuples():
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows")
    again = queries.op1_shard(spark, SF).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert out.sort_values("doc_id")[key].values.tolist() == again.sort_values("doc_id")[key].values.tolist()


def test_shuffle_doesnt_depend_on_order_and_mixes(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(df.repartition(7), shards=4, bucket_rows=300).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(df.orderBy(F.desc("doc_id")), shards=4, bucket_rows=300).collect()}
    assert a == b
    places = [s * 500 + t for _, (s, t) in sorted(a.items())]
    assert abs(np.corrcoef(range(2000), places)[0, 1]) < 0.1
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(df, shards=4, bucket_rows=300, seed=5).collect()}
    assert a != other


def test_shuffle_odd(odd, none):
    out = got(sharding.shard_digest(odd, new_folder()))
    assert len(out) == len(ROWS) and {r["size"] for r in out if r["doc_id"] == 2} == {1}
    assert sorted((r["shard"], r["slot"]) for r in out) == [(i, 0) for i in range(11)]
    assert got(sharding.shard_digest(none, new_folder())) == []
    replaced = sharding.external_shuffle(odd, shards=3)  # the columns shard and slot of the rows themselves give way
    assert sorted(replaced.columns) == sorted(odd.columns) and sorted((r["shard"], r["slot"]) for r in got(replaced)) == sorted((i % 3, i // 3) for i in range(11))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200).alias("text"))
    sharding.write_shards(rows, str(tmp_path / "many"), shards=2, bucket_rows=300)
    for shard in range(2):
        files = sorted((tmp_path / f"many/shard={shard}").glob("*.parquet"))
        assert len(files) == 3 and [s for f in files for s in pd.read_parquet(f).slot] == list(range(450))


def test_no_key_or_row_fills_a_bucket(spark):
    rows = [(None, f"text {i}") for i in range(1500)] + [(1, "the same")] * 1500 + [(i, "x" * 50) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, buckets = sharding.scattered(df, "doc_id", 7, None, 200, 1 << 20)
    counts = [r["count"] for r in found.groupBy("__bucket").count().collect()]
    assert buckets == 18 and sum(counts) == 3500 and max(counts) < 400
    out = got(sharding.external_shuffle(df, shards=3, bucket_rows=200))
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in out) == sorted(((i or -1), t) for i, t in rows)
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted((i % 3, i // 3) for i in range(3500))


def test_buckets_are_sized_by_bytes(spark):
    df = spark.createDataFrame([(i, str(i) * 2000) for i in range(100, 200)], "doc_id long, text string")
    assert sharding.scattered(df, "doc_id", 7, None, 20_000, 60_000)[1] == 11


def test_shards_are_made_of_whole_documents(odd, monkeypatch):
    real, seen = sharding.external_shuffle, []
    monkeypatch.setattr(sharding, "external_shuffle", lambda df, *a, **k: seen.append(df.schema["row"].dataType.names) or real(df, *a, **k))
    assert len(got(sharding.shard_digest(odd, new_folder()))) == len(ROWS) and seen == [odd.columns]


def test_every_order_of_a_bucket_is_as_likely(spark):
    """Fisher-Yates: over many seeds, each of the 24 orders of four rows comes about as often (chi-squared, 23 degrees)."""
    seeds = 1200
    row = spark.range(1).select(*[F.shuffle(F.array(*map(F.lit, range(4))), s).alias(f"s{s}") for s in range(seeds)]).first()
    found = pd.Series([tuple(x) for x in row]).value_counts()
    assert len(found) == 24 and ((found - seeds / 24) ** 2 / (seeds / 24)).sum() < 50


# 2 packing


def check_packing(out, docs, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    want = {}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            piece = np.array(ids[k : k + capacity], "<u4").tobytes()
            want.setdefault((i, k // capacity, k, len(piece) // 4, zlib.crc32(piece)), 0)
            want[(i, k // capacity, k, len(piece) // 4, zlib.crc32(piece))] += 1
    have = {}
    for r in out:
        key = (r["__id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
    assert have == want
    for _, parts in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for p in parts:
            assert p["offset"] == end
            end += p["length"]
        assert end <= capacity
    return len({r["sequence_id"] for r in out})


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack_documents(docs, with_ids=True)
    out = got(packed)
    used = check_packing(out, documents()[["doc_id", "text"]].values.tolist())
    assert used <= math.ceil(sum(r["length"] for r in out) / 4096) + 1
    whole = {r["sequence_id"]: r["ids"] for r in got(packing.sequences(packed))}
    for r in out:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_packing_odd(odd, none):
    check_packing(got(packing.pack_documents(odd)), [(r[0], r[1]) for r in ROWS])
    assert got(packing.pack_documents(none)) == []


@pytest.mark.parametrize("seed", range(6))
def test_layout_is_whole(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 400) if rng.random() < 0.5 else rng.randint(1, 4096): rng.randint(1, 50) for _ in range(rng.choice([1, 5, 300]))}
    for groups in (0, *packing.GROUPS):
        plan = packing.layout(counts, 4096, groups)
        fill, placed = {}, {}
        for n, rank, count, first, each, offset in plan.runs:
            for i in range(count):
                fill.setdefault(first + i // each, []).append((offset + i % each * n, n))
                assert placed.setdefault((n, rank + i), 0) == 0
                placed[(n, rank + i)] = 1
        assert {n: sum(1 for k in placed if k[0] == n) for n in counts} == counts
        for parts in fill.values():
            end = 0
            for offset, n in sorted(parts):
                assert offset == end
                end += n
            assert end <= 4096
        assert len(fill) == plan.sequences and plan.sequences <= 1.25 * sum(n * c for n, c in counts.items()) / 4096 + 2 + sum(c for n, c in counts.items() if n > 2048)


@pytest.mark.parametrize("lengths", [[4096], [3000, 2000], [700] * 3, [5, 6, 2048, 2048]])
def test_few_large_documents_are_grouped_too(lengths, monkeypatch):
    seen, real = [], packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda sizes, wanted, capacity: seen.append((sizes, wanted)) or real(sizes, wanted, capacity))
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.layout(counts)
    large = [n for n in lengths if n > 4096 / 6]
    assert sum(seen[0][1]) == len(large) and sum(r[2] for r in plan.runs) == len(lengths) and plan.sequences == math.ceil(sum(lengths) / 4096)


def test_early_stop_is_said(monkeypatch, caplog):
    monkeypatch.setattr(packing, "ROUNDS", 0)
    assert packing.configurations([3000, 1000], [5, 5], 4096) and "before the optimum" in caplog.text


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, t = Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello  world, it's\n 12.5", "", "a b c"]
    assert not own.pieces and Encoder().pieces and [np.frombuffer(x, "<u4").tolist() for x in own.many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    texts = [*documents().text.head(60), "", "It's Ünïcödé don't ＡＢＣ İstanbul ΣΑΣ ñ.,!x a.b a'.,' 'll x12y  nb sp <|endoftext|> ﬁ ẞ Ⅷ ª º µ, é́. a.́", "中文 字,, 한글 ก็", "a\x0bb\x0cc\x1cd\x85e  .. ,x, !?! ***|", "× a× ÷. x÷,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder().many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    t.encode_special_tokens = True
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(plain=True).many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 3 quality


def test_quality_held_out(spark):
    out = queries.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").drop_duplicates("doc_id")
    assert len(out) == 1000 and (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all() and out.score.between(0, 1).all()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.9


def test_quality_scores_by_brute_force(spark):
    """Each piece compressed apart with each dictionary, by the library's plain calls."""
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    size = lambda data, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    for r in got(docs.limit(25).withColumn("__score", quality.score(model, F.col("text")))):
        data = (r["text"] or "").encode()
        parts = [data[k : k + 192] for k in range(0, len(data), 192)]
        good, bad = (sum(size(p, d) for p in parts) for d in (model.good, model.bad))
        x = model.weights[0] * (bad - good) / (bad + good) + model.weights[1] * (bad - good) / len(data) + model.weights[2]
        assert len(model.weights) == 3 and math.isclose(r["__score"], 1 / (1 + math.exp(-x)), abs_tol=1e-9)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = got(quality.classify(odd, labels))
    assert len(out) == len(ROWS) and all(0 <= r["__score"] <= 1 for r in out)
    assert len({r["__score"] for r in out if not r["text"]}) == 1
    assert got(quality.classify(none, labels)) == [] and len(got(quality.classify(odd, labels.limit(0)))) == len(ROWS)


def test_quality_never_learns_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(docs, labels) == quality.learn(docs, flipped)


# 4 language


def test_language_held_out(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    m = out[out.held_out].merge(docs, on="doc_id")
    assert (m.lang_pred == m.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_odd(spark, odd, none):
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    out = {(r["doc_id"], r["text"]): r for r in got(language.identify(odd, model, F.col("text")))}
    assert out[(2, None)]["__lang"] == out[(3, "")]["__lang"] == out[(9, " \t\n")]["__lang"] == "und" and out[(8, ROWS[8][1])]["__lang"] in model.languages
    assert got(language.identify(none, model, F.col("text"))) == []
    empty = language.learn(none)
    assert {r["__lang"] for r in got(language.identify(odd, empty, F.col("text")))} == {"und"}


def test_language_learns_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_CHARS", 200)
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=6)) for _ in range(n))
    rows = [(i, text("abcde", 10), "short") for i in range(60)] + [(100 + i, text("vwxyz", 200), "long") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["long", "short"]
    assert {(r["lang"], r["__lang"]) for r in got(language.identify(docs, model, F.col("text")))} == {("long", "long"), ("short", "short")}
    sampled = language._sampled(docs, "doc_id", "text", "lang", 800).where("__lang = 'long'").toPandas()
    assert len(sampled) == sum(zlib.crc32(str(100 + i).encode()) % 4 != 2 for i in range(60)) and (sampled["__text"].str.len() <= 210).all()


def test_language_tells_many_letters_apart(spark):
    rng = random.Random(5)
    text = lambda first, n: " ".join("".join(chr(first + rng.randrange(n)) for _ in range(4)) for _ in range(30))
    # the frequent language has 300 letters, so that the others' aren't among the 254 most frequent ones
    kinds = {"many": (0x4E00, 300, 400), "ka": (0x10D0, 30, 20), "hy": (0x0561, 30, 20)}
    rows = [(i * 10 + k, text(first, n), lang) for k, (lang, (first, n, many)) in enumerate(kinds.items()) for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(set(model.symbols[[0x10D0, 0x10D1, 0x0561, 0x0562]].tolist())) == 4
    assert all(r["lang"] == r["__lang"] for r in got(language.identify(docs, model, F.col("text"))))


def test_quality_learns_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_CHARS", 200)
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(100))
    docs = spark.createDataFrame([(i, text("abcde" if i % 2 else "vwxyz")) for i in range(120)], "doc_id long, text string")
    out = got(quality.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")))
    assert all((r["__score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in out)


def test_kneser_ney_sums_to_one():
    symbols = np.where(language.is_letter_table(), np.uint32(language.ALPHABET), np.uint32(0)).astype(np.uint32)
    for i, c in enumerate("abcde", 1):
        symbols[ord(c)] = i
    text = language._padded(language._codes(language._points("abc abd ecb bad cab " * 3), symbols))
    grams, n = np.unique(language._ngrams(text, 4), return_counts=True)
    reader = language.Reader(language.kneser_ney({"x": (grams, n.astype(float)), "y": (grams[:5], np.ones(5))}, symbols))
    for context in ((0, 0, 1), (1, 2, 3), (5, 5, 5), (2, 1, 4)):
        p = [np.exp2(reader.logs(np.array([*context, c], np.uint32))[0]) for c in range(256)]
        assert np.allclose(np.sum(p, 0), 1, atol=0.02)


def test_kneser_ney_by_brute_force():
    """Interpolated Kneser-Ney by its recursive definition, with counts in dictionaries."""
    texts = {"x": "abc abd ecb bad cab abab", "y": "dda eed dad abed"}
    symbols = np.where(language.is_letter_table(), np.uint32(language.ALPHABET), np.uint32(0)).astype(np.uint32)
    for i, c in enumerate("abcde", 1):
        symbols[ord(c)] = i
    padded = {k: language._padded(language._codes(language._points(t), symbols)) for k, t in texts.items()}
    counts = {k: np.unique(language._ngrams(s, 4), return_counts=True) for k, s in padded.items()}
    reader = language.Reader(language.kneser_ney({k: (g, n.astype(float)) for k, (g, n) in counts.items()}, symbols))
    for j, lang in enumerate(sorted(texts)):
        tables = {4: {}}
        s = padded[lang].tolist()
        for k in range(3, len(s)):
            gram = tuple(s[k - 3 : k + 1])
            tables[4][gram] = tables[4].get(gram, 0) + 1
        for n in (3, 2, 1):
            tables[n] = {}
            for gram in tables[n + 1]:
                tables[n][gram[1:]] = tables[n].get(gram[1:], 0) + 1

        def p(gram):
            if not gram:
                return 1 / (language.ALPHABET + 1)
            own = {g: c for g, c in tables[len(gram)].items() if g[:-1] == gram[:-1]}
            if not own:
                return p(gram[1:])
            total = sum(own.values())
            return max(own.get(gram, 0) - 0.75, 0) / total + 0.75 * len(own) / total * p(gram[1:])

        for text in ("abc", "dab eed", "zzz a"):
            q = language._padded(language._codes(language._points(text), symbols))
            want = [math.log2(p(tuple(q[k - 3 : k + 1].tolist()))) for k in range(3, len(q))]
            assert np.allclose(reader.logs(q)[:, j], want, atol=1e-3)


def test_a_model_too_large_is_an_error(spark, odd, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        language.identify(odd, language.learn(spark.read.parquet(f"{SF}/documents.parquet")), F.col("text"))


# 5 exact duplicates


def brute_exact(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0))
    return {(i, t): (None if min(groups[norm(t)])[1] else min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_exact_duplicates(spark, odd, id_bytes):
    """With identifiers of one byte many chunks collide, and the verified way gives the same result."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(300)]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, " ".join(rng.choices(words, k=rng.choice([3, 400, 2000])))) for i in range(60)]
    rows += [(300 + i, rows[20 + i][1].replace(" ", "  ")) for i in range(20)] + [(400 + i, rows[40 + i][1]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_exact(rows)
    out = got(exact_dedup.exact_duplicates(docs.withColumn("__best", F.lit(1)), id_bytes=id_bytes).join(docs.distinct().withColumn("k", F.xxhash64("text")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__key"))))
    assert len(out) == len(rows)
    for r in out:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[(r["doc_id"], r["text"])]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_chunks_are_content_defined():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghij", k=60_000)).encode()
    a = {h for h, _ in exact_dedup._chunks(text, 16)}
    b = {h for h, _ in exact_dedup._chunks(b"inserted" + text, 16)}
    assert len(a & b) >= len(a) - 3
    assert b"".join(p for _, p in exact_dedup._chunks(text, 16)) == text


def test_drop_exact_odd(odd, none):
    left = got(exact_dedup.drop_exact_duplicates(odd))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left) == [(False, i) for i in (4, 5, 8, 9, 10)] + [(True, 0)]
    assert got(exact_dedup.drop_exact_duplicates(none)) == []


def test_rows_that_share_an_id_leave_one(spark):
    rows = [(6, "a bc"), (6, "ab c"), (6, "ab c"), (7, "other"), (7, "ot her x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = got(exact_dedup.drop_exact_duplicates(docs))
    assert len(left) == 3 and sum(r["doc_id"] == 6 for r in left) == 1
    near = got(simhash.drop_near_duplicates(spark.createDataFrame([(6, "A b c d e"), (6, "a B c d e"), (5, "z y x w v u t")], "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in near) == [5, 6]


def test_more_salts_change_nothing(spark, odd, monkeypatch):
    few = sorted(map(str, got(exact_dedup.exact_duplicates(odd)))), sorted(map(str, got(simhash.near_duplicates(odd))))
    monkeypatch.setattr(common, "SALT_ROWS", 0.2)
    assert common.salts_for(11) == 55
    assert few == (sorted(map(str, got(exact_dedup.exact_duplicates(odd)))), sorted(map(str, got(simhash.near_duplicates(odd)))))


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


# 6 secrets


def brute_candidates(text):
    import re

    hits = [(m.start(), m[0], re.match(secrets.LEAD, m[0])) for m in re.finditer(secrets.CANDIDATE, text)]
    return {(at + (len(lead[0]) if lead else 0), hit[len(lead[0]) if lead else 0 :]) for at, hit, lead in hits}


def test_secret_candidates_of_every_form(spark):
    forms = [  # text, candidates; names go to what is before
        ('password: "Tr0ub4dor&3x!"', ["Tr0ub4dor&3x!"]),
        ("API_KEY=abcdefgh12345678abcd", ["abcdefgh12345678abcd"]),
        ("MY_LONG_SERVICE_PASSWORD=Tr0ub4dor&3x! next", ["Tr0ub4dor&3x!"]),
        ("postgres://admin:s3cr-t!pass@db.internal/x", ["s3cr-t!pass"]),
        ("{'client-secret' => 'q;w(e)r,ty'}", ["q;w(e)r,ty"]),
        ("pwd := short1; token==abcdefghij; secret::abcdefghij", []),
        ("SOME_OTHER_LONG_NAME=YWJjZGVmZ2hpamtsbW5vcA== end", ["SOME_OTHER_LONG_NAME", "YWJjZGVmZ2hpamtsbW5vcA=="]),
        ("secret = get_password(x)", ["get_password"]),
        ("token = \n abcdefghijkl", []),
        ("x" * 300_000 + "=", ["x" * 300_000 + "="]),  # padding
        ("tokentoken" * 30_000, ["tokentoken" * 30_000]),
        ("api_key: é漢字😀pass1 and é", ["é漢字😀pass1"]),
    ]
    df = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(forms)], "doc_id long, text string, source string")
    rows = got(secrets.candidates(df))
    for i, (t, want) in enumerate(forms):
        mine = {(r["start"], r["candidate"]) for r in rows if r["__id"] == i}
        assert mine == brute_candidates(t) and sorted(c for _, c in mine) == sorted(want), t[:60]
        assert all(t[at : at + len(c)] == c for at, c in mine)
    assert {r["before"] for r in rows if r["__id"] == 1} == {"API_KEY="}


def test_secret_candidates_and_verdicts(odd, none):
    text = "key 0123456789abcdef0123 and AAAABBBBCCCCDDDD1111.\nx"
    df = odd.select(F.lit(7).alias("doc_id"), F.lit(text).alias("text"), F.lit("p").alias("source")).limit(1)
    found = {(r["start"], r["candidate"]) for r in got(secrets.candidates(df))}
    assert found == brute_candidates(text)
    out = got(secrets.scan(odd))
    assert [(r["__id"], r["start"], r["is_secret"]) for r in out] == [(10, ROWS[-1][1].index("0123"), True)]
    assert got(secrets.scan(none)) == []
    plan = secrets.candidates(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(") == 1  # a text is searched once
    assert "[secret]" in [r["text"] for r in got(secrets.redact(odd, secrets.scan(odd))) if r["doc_id"] == 10][0]


def test_secrets_of_held_out_forms(spark):
    learned, other = secrets.labelled_findings(spark), secrets.labelled_findings(spark, 2000, held_out=True)
    rows = learned.collect()
    # neither the tables' addresses and noise mark nor their planted form
    assert not [r for r in rows if "mail" in r["candidate"] or "###" in r["after"] or (r["label"] == 1 and len(r["candidate"]) == 40 and not set(r["candidate"]) - set("0123456789abcdef"))]
    words = spark.createDataFrame([("the", 9), ("and", 5), ("file", 2)], "w string, n long")
    precision, recall = secrets.Forest(learned, words).precision_and_recall(other)
    print("held-out forms: precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.8


def test_secrets_in_documents(spark):
    import re

    out = queries.op6_secrets(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text
    planted = {(i, m.start(1)) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    secret = out[out.is_secret]
    assert {(r.doc_id, r.start) for r in secret.itertuples()} >= planted and len(secret) <= len(planted) * 1.1 + 2
    every = {(i, at, len(c)) for i, t in docs.items() for at, c in brute_candidates(t)}
    assert {(r.doc_id, r.start, r.length) for r in out.itertuples()} == every


# 7 SimHash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash_whole(spark):
    out = queries.op7_simhash(spark, SF).toPandas().sort_values("doc_id")
    docs = documents().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs.text]
    assert out.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    ids = docs.doc_id.tolist()
    assert out.component_id.tolist() == [ids[r] for r in brute_components(fps)]


def test_simhash_odd(odd, none):
    out = got(simhash.near_duplicates(odd))
    assert len(out) == len(ROWS)
    zero = {r["__id"]: r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert zero == {2: 2, 3: 2, 9: 2}
    assert got(simhash.near_duplicates(none)) == []
    assert len(got(simhash.drop_near_duplicates(odd))) == len({r["component_id"] for r in out})


@pytest.mark.parametrize("small, tile", [(48, 1024), (1, 16)])
def test_links_lose_nothing(spark, small, tile):
    """Dense clusters around few centres, also with every bucket compared in tiles."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(f,) for f in fps], "__fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, small=small, tile=tile)).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in fps])
    assert [found.get(f, f) for f in fps] == [fps[w] for w in want]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 8 token counts


def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), documents()[["doc_id", "text"]].values.tolist()), (odd, [(r[0], r[1]) for r in ROWS])):
        out = got(token_counts.document_token_counts(df, file_rows=20, block=700))
        key = lambda x: (x[0] is None, x)
        assert sorted(((r["__id"], r["n_tokens"]) for r in out), key=key) == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=key)
    assert got(token_counts.document_token_counts(none)) == []


@pytest.mark.parametrize("block", [1, 3, 64])
def test_separator_scan_of_files(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_counts, "SUMMED", 4)
    rng = random.Random(block)
    want = []
    for name in ("a", "b", "c"):
        lengths = [rng.choice([0, 1, 2, 17]) for _ in range(12)]
        tail = 5 if name == "b" else 0
        flat = [x for n in lengths for x in [*[9] * n, token_counts.SEPARATOR]] + [9] * tail
        np.array(flat, "<u2").tofile(tmp_path / f"{name}.bin")
        start = 0
        for k, n in enumerate(lengths + [tail] * (tail > 0)):
            want.append((name, k, start, n, not (tail and k == len(lengths))))
            start += n + 1
    np.array([], "<u2").tofile(tmp_path / "empty.bin")
    out = got(token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), block)))
    assert sorted((r["file"].rsplit("/", 1)[1][0], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in out) == sorted(want)


def test_token_file_over_two_gigabytes(spark, tmp_path):
    tokens, ends = 1_100_000_000, [5, 5 + (1 << 24), 1_099_999_999]
    with open(tmp_path / "a b.bin", "wb") as out:
        for e in ends:
            out.seek(2 * e)
            out.write(np.array([token_counts.SEPARATOR], "<u2").tobytes())
    assert (tmp_path / "a b.bin").stat().st_size == 2 * tokens > 1 << 31
    blocks = token_counts.read_token_files(spark, str(tmp_path), block=1 << 23)
    assert blocks.rdd.getNumPartitions() > 8
    out = got(token_counts.count_tokens(blocks))
    starts = [0, *(e + 1 for e in ends[:-1])]
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in out) == [(k, b, e - b, True) for k, (b, e) in enumerate(zip(starts, ends))]


# 9 fingerprints


def test_fingerprints_and_neighbours(spark):
    out = {r["doc_id"]: r for r in got(queries.op9_fingerprint(spark, SF))}
    docs = documents().sort_values("doc_id", ascending=False)
    texts, ids = docs.text.tolist(), docs.doc_id.tolist()
    assert set(out) == set(ids)
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        nxt, r = texts[(k + 1) % len(texts)], out[i]
        other = fingerprints.edited(t, nxt)
        hexes = lambda x: fingerprints.text_signature(x).astype(">u2").tobytes().hex()
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(other.encode()).hexdigest(), hexes(t), hexes(other))
        assert r["near_next"] == fingerprints.likeness(fingerprints.text_signature(t), fingerprints.text_signature(nxt))
    assert np.mean([r["near_edited"] for r in out.values()]) > np.mean([r["near_next"] for r in out.values()]) + 0.2


def test_many_ranges(spark):
    """Ranges of some rows, with the next document of each one's last in another task."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r["edited_sha256"] for r in got(fingerprints.fingerprint_documents(table, ranges=200).select("doc_id", "edited_sha256"))}
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id", ascending=False)
    texts = docs.text.tolist()
    assert [out[i] for i in docs.doc_id] == [hashlib.sha256(fingerprints.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest() for k, t in enumerate(texts)]


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_ids_of_any_type_in_order(spark, kind):
    """Null, repeated and shared ids over ranges of few rows; the next row is the one with the next smaller (id, digest)."""
    made = lambda i: None if i is None else f"k{i}" if kind == "string" else i
    rows = [(made(i), f"words {k} of row {'same' if k in (3, 4) else k}") for k, i in enumerate([5, 1, 1, 9, 9, 1, None, None, 12, 3, 3])]
    rows[4] = rows[3]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    keys = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or made(0), keys[r[1]]), reverse=True)
    want = sorted((str(i), hashlib.sha256(fingerprints.edited(t, ordered[(n + 1) % len(ordered)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(ordered))
    out = fingerprints.fingerprint_documents(df, ranges=5)
    assert dict(out.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got(out)) == want


def test_rows_that_repeat_spread_over_ranges(spark):
    """A third of the rows have neither id nor text; they fill several ranges, and each is followed by the next."""
    rows = [(None, None)] * 50 + [(i, f"words of row {i}") for i in range(100)]
    out = got(fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ranges=6))
    by = lambda i: [r for r in out if r["doc_id"] == i]
    assert len(out) == 150 and len(by(None)) == 50 and sum(r["near_next"] == 1.0 for r in by(None)) == 49
    assert [r["near_next"] for r in by(0)] == [0.0] and all(len(by(i)) == 1 for i in range(100))


def test_fingerprints_odd(odd, none, spark):
    rows = odd.where("doc_id is not null")
    out = got(fingerprints.fingerprint_documents(rows))
    assert len(out) == len(ROWS) - 1 and {r["n_chars"] for r in out if r["doc_id"] == 2} == {0}
    assert len(got(fingerprints.fingerprint_documents(odd))) == len(ROWS)
    assert got(fingerprints.fingerprint_documents(none)) == []
    one = got(fingerprints.fingerprint_documents(spark.createDataFrame([(5, "x y")], "doc_id long, text string")))
    assert one[0]["near_next"] == 1.0


def test_collision_rate_is_generalised_jaccard(monkeypatch):
    monkeypatch.setattr(fingerprints, "SAMPLES", 4000)
    monkeypatch.setattr(fingerprints, "_ODD", np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    rng = random.Random(2)
    for _ in range(4):
        a = {f"t{i}": rng.choice([1.0, 1.7, 3.2]) for i in rng.sample(range(40), 25)}
        b = {f"t{i}": rng.choice([1.0, 1.7, 3.2]) for i in rng.sample(range(40), 25)}
        keys = a.keys() | b.keys()
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        assert abs(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - true) < 0.035


# 10 mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_targets(spark):
    out = queries.op10_mix(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    out["source"] = out.doc_id.map(docs.source)
    target = brute_targets(out.groupby("source")["size"].sum().to_dict())
    assert (out.taken <= 2 * out["size"]).all() and (out["size"] == [len(docs.text[i].split()) for i in out.doc_id]).all()
    for s, part in out.groupby("source"):
        assert math.isclose(part.target.iloc[0], target[s], rel_tol=1e-9)
        assert abs(part.taken.sum() - target[s]) <= 1.5 * part["size"].max()
    emitted = mixing.emit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert emitted.columns == list(pd.read_parquet("/root/testdata/sf0.01/documents.parquet").columns)
    assert emitted.count() == int((out.taken / out["size"].where(out["size"] > 0)).sum())


def test_the_probability_of_a_copy_is_the_fraction(spark):
    """Over many seeds, documents of every size get their further copy equally often, as often as the fraction says; and no mix is far from its target."""
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200, 900]), f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    runs = [mixing.mix(docs, seed=f"seed {k}").select("doc_id", "__copies", "__source_size", "__target", "__size", "source", F.lit(k).alias("k")) for k in range(8)]
    out = pd.concat([r.toPandas() for r in runs])
    first = out.groupby("source")[["__target", "__source_size"]].first()
    rate = first["__target"] / first["__source_size"]
    mean = out.groupby(["source", "__size"])["__copies"].agg(["mean", "count"])
    for (s, _), r in mean.iterrows():
        assert abs(r["mean"] - rate[s]) < 4.5 * math.sqrt(0.25 / r["count"])
    sums = (out["__size"] * out["__copies"]).groupby([out["k"], out["source"]]).sum()
    target = out.groupby("source")["__target"].first()
    assert all(abs(v - target[s]) <= 1.5 * 900 for (_, s), v in sums.items())


def test_mix_odd(odd, none, monkeypatch):
    out = got(mixing.mix(odd))
    assert len(out) == len(ROWS) and {r["__size"] for r in out if r["doc_id"] in (2, 3, 9)} == {0}
    assert {r["source"] for r in out if r["doc_id"] == 2} == {None} and all(0 <= r["__copies"] <= 2 for r in out)
    assert got(mixing.emit(none)) == [] and got(mixing.mix(none)) == []
    words = lambda df: df.selectExpr("sum(__size * __copies) s").first().s
    assert words(mixing.mix(odd.repartition(5))) == words(mixing.mix(odd.coalesce(1)))


# very long texts go through in windows


def test_windows_change_nothing(monkeypatch):
    texts = [t for t in documents().text.head(40)] + ["", "a b c", "a b c d", " x ", "one"]
    before = [simhash.fingerprint(t) for t in texts], [fingerprints.text_signature(t).tolist() for t in texts], [exact_dedup.chunk_ends(t.encode()) for t in texts], list(Encoder().many(texts))
    monkeypatch.setattr(common, "WINDOW_BYTES", 40)
    monkeypatch.setattr(exact_dedup, "WINDOW", 100)
    monkeypatch.setattr(tokens, "AHEAD", 25)
    after = [simhash.fingerprint(t) for t in texts], [fingerprints.text_signature(t).tolist() for t in texts], [exact_dedup.chunk_ends(t.encode()) for t in texts], list(Encoder().many(texts))
    assert before == after
    assert before[0] == [brute_fingerprint(t) for t in texts]


def test_rows_without_id_and_text_spread(spark):
    rows = [(None, None, "s")] * 400 + [(i, f"text number {i} of many", "s") for i in range(800)] + [(i, f"text number {i} of many", "s") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    cut = common.checkpointed(docs)
    salts = cut.where("doc_id is null").select(F.pmod(F.xxhash64(common.by_row("doc_id")), F.lit(16)).alias("s"))
    sizes = [r["count"] for r in salts.groupBy("s").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 60  # one salt held all 400 while ids alone decided
    exact = exact_dedup.exact_duplicates(docs)
    assert exact.count() == len(rows)
    assert {(r.keep_id, r.group_size, r.kept) for r in exact.where("__id is null").collect()} == {(None, 400, True)}
    assert {r.group_size for r in exact.where("__id < 50").collect()} == {2} and exact.where("__id >= 50 and group_size = 1 and kept").count() == 750
    near = simhash.near_duplicates(docs)
    assert near.count() == len(rows) and {(r.fingerprint, r.component_id) for r in near.where("__id is null").collect()} == {("0" * 16, None)}
