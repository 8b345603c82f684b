"""Residuals, intervals of validity, the tree of hashes, staged writes, refreshed partitions, and the layer with two writers."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snapledger.operators import hashtree, intervals, residual, validity
from snapledger.sources import refresh, staging, store

# residuals


def test_causes_are_taken_in_order(spark):
    rows = [("none", 0, False), ("whole", 100, False), ("both", 130, False), ("part", 100, False), ("away", 100, True), ("swap", 55, True), ("open", 9, False), ("null", None, True), ("over", 10, False), ("neg", -70, False)]
    causes = [("whole", 1, "x", 100), ("both", 2, "y", 30), ("both", 1, "x", 100), ("part", 1, "x", 60), ("away", 1, "x", -5), ("over", 1, "x", 25), ("over", 2, "y", 4), ("neg", 1, "x", -70), ("neg", 2, "y", -3), ("open", 1, "x", None), ("swap", 1, "x", 0), ("whole", 2, "y", 1), ("none", 1, "x", 3)]
    d = spark.createDataFrame(rows, "k string, diferenca long, trocada boolean")
    c = residual.gathered(spark.createDataFrame(causes, "k string, o int, causa string, valor long"), ["k"], "o", "causa", "valor")
    out = {r.k: (r.classe, [tuple(t) for t in r.tomadas], r.resto) for r in residual.classify(d, c, ["k"], "diferenca", "trocada").collect()}
    assert out == {
        "none": ("concorda", [], 0), "whole": ("causa_comprovada", [("x", 100)], 0), "both": ("causa_comprovada", [("x", 100), ("y", 30)], 0), "part": ("causa_parcial", [("x", 60)], 40),
        "away": ("regra_de_classificacao", [("troca de soma zero", 100)], 0), "swap": ("regra_de_classificacao", [("troca de soma zero", 55)], 0), "open": ("sem_causa", [], 9), "null": (None, [], None), "over": ("causa_parcial", [("y", 4)], 6), "neg": ("causa_comprovada", [("x", -70)], 0),
    }
    assert all(sum(v for _, v in t) + rest == dict((k, v) for k, v, _ in rows)[k] for k, (_, t, rest) in out.items() if rest is not None)


def test_paired_columns(spark):
    rows = [(1, "a", 5), (1, "f", -5), (1, "b", 3), (1, "g", -2), (2, "a", 0), (2, "f", 0), (2, "L", 7)]
    out = residual.cancelled_by_pair(spark.createDataFrame(rows, "p int, c string, d long"), ["p"], "c", "d", [("a", "f"), ("b", "g")], "s")
    assert {(r.p, r.c) for r in out.where("s").collect()} == {(1, "a"), (1, "f")} and out.count() == len(rows)


# intervals


def some_snapshots(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(3):02d}:00:00", rng.random() < 0.3, i * 10) for i in range(200)]
    rows += [(200, 0, None, False, 1), (201, 9, "2024-01-05 00:00:00", True, 1)]
    return spark.createDataFrame(rows, "uid long, k long, t string, bad boolean, valor long").withColumn("ts", F.to_timestamp("t")).drop("t")


def test_intervals_answer_every_instant(spark, tmp_path):
    rows = some_snapshots(spark)
    found = intervals.intervals(rows, ["k"], ["ts", "uid"], "ts", ~F.col("bad"), ["uid", "valor"])
    found.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    texts = [intervals.canonical_text(x) for x in ("2024-01-03", "2024-01-15T01:00:00+00:00", "2024-02-01", "2023-12-31")]
    for text in texts:
        want = validity.current(rows, ["k"], ["ts", "uid"], ["uid", "valor"], ~F.col("bad"), em=intervals.instant(text), concluded="ts")
        one = intervals.valid_at(stored, intervals.instant(text))
        assert sorted(map(tuple, one.select("k", "uid", "valor").collect())) == sorted(map(tuple, want.select("k", "uid", "valor").collect()))
        assert sorted(map(tuple, intervals.valid_at_each(stored, texts).where(F.col("vigencia") == text).select("k", "uid", "valor").collect())) == sorted(map(tuple, one.select("k", "uid", "valor").collect()))
    plan = intervals.valid_at(stored, intervals.instant(texts[0]))._jdf.queryExecution().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "LessThanOrEqual(de" in pushed and "GreaterThan(ate" in pushed
    # neither gaps nor overlaps
    ends = [tuple(r) for r in stored.orderBy("k", "de").select("k", "de", "ate").collect()]
    assert all(a[2] == b[1] if a[0] == b[0] else a[2] is None for a, b in zip(ends, ends[1:], strict=False))


def test_other_forms_of_an_instant_are_refused():
    assert intervals.canonical_text("2024-01-10") == "2024-01-10T23:59:59-03:00" and intervals.canonical_text("2024-01-10T12:00:00+00:00") == "2024-01-10T09:00:00-03:00"
    for text in ("2024-01-10", "2024-01-10T09:00:00", "2024-01-10T12:00:00+00:00", "2024-01-10T09:00:00.000-03:00"):
        with pytest.raises(ValueError, match="canonical"):
            intervals.instant(text)
    with pytest.raises(ValueError):
        intervals.instant("soon")


# tree


def test_the_tree_finds_losses_and_allows_growth(spark):
    rows = [(i, f"v{i}") for i in range(0, 3000, 3)]
    df = lambda x: spark.createDataFrame(x, "id long, v string")
    old = df(rows)
    before = hashtree.tree(old, "id", ["v"], 32, 4)
    height = max(r.nivel for r in before.collect())
    assert before.where(F.col("nivel") == height).count() == 1 and before.where("nivel = 0").count() == 94

    def found(now):
        new = df(now)
        unlike = hashtree.differing(before, hashtree.tree(new, "id", ["v"], 32, 4, height), 4)
        return {r.no for r in unlike.where("nivel = 0").collect()}, {(r.id, r.situacao) for r in hashtree.losses(old, new, unlike, "id", ["v"], 32).collect()}

    assert found(rows[::-1]) == (set(), set())
    grown = [*rows, *((i, "new") for i in range(3008, 20_000, 7))]
    assert found(grown) == (set(), set())
    assert found([*rows, (3001, "same leaf")]) == ({3001 // 32} if 2997 // 32 == 3001 // 32 else set(), set())
    bad = [(i, "other" if i == 600 else v) for i, v in grown if i != 2001]
    assert found(bad) == ({2001 // 32, 600 // 32}, {(2001, "perdido"), (600, "alterado")})
    assert found([(1, "x")])[1] == {(i, "perdido") for i, _ in rows}
    assert hashtree.tree(df([]), "id", ["v"]).count() == 0 and hashtree.differing(hashtree.tree(df([]), "id", ["v"]), before).count() == 0


# staged writes


def test_a_write_is_whole_or_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    parents = spark.createDataFrame([("a",), ("b",)], "uid string")
    views = spark.createDataFrame([(1, 5, ["a", "b"]), (2, 7, ["b"]), (3, None, None), (4, 1, [])], "id long, valor long, coletas array<string>")

    def tables(views, expected=4):
        link = staging.linked(staging.links(views, ["id"], "coletas", "uid"), "uid", parents, "uid", "__solta")
        return {"visao": staging.Table(views, {"negativa": F.col("valor") < 0}, expected), "ligacao": staging.Table(link, {"coleta inexistente": F.col("__solta")})}

    assert staging.read_published(spark, root, "visao") is None
    assert set(staging.write_all(spark, root, tables(views)).values()) == {0}
    assert staging.read_published(spark, root, "visao").count() == 4 and staging.read_published(spark, root, "ligacao").columns == ["id", "uid"]
    dangling = views.withColumn("coletas", F.when(F.col("id") == 2, F.array(F.lit("z"), F.lit("y"))).otherwise(F.col("coletas")))
    for bad, rule, n in ((tables(dangling), ("ligacao", "coleta inexistente"), 2), (tables(views.withColumn("valor", -F.col("valor"))), ("visao", "negativa"), 3), (tables(views, 5), ("visao", "contagem"), 1)):
        with pytest.raises(staging.Refused) as e:
            staging.write_all(spark, root, bad)
        assert e.value.violations == {rule: n}
        assert staging.read_published(spark, root, "visao").agg(F.sum("valor")).first()[0] == 13 and len([p for p in Path(root).iterdir() if p.is_dir()]) == 2
    staging.write_all(spark, root, tables(views.where("id < 3"), 2))
    assert staging.read_published(spark, root, "visao").count() == 2


def test_two_publishers(spark, tmp_path):
    root = str(tmp_path / "p")
    assert store.published(spark, root) is None
    assert store.publish(spark, root, "one") < store.publish(spark, root, "two")
    assert not store.write_text(spark, f"{root}/_published/{1:012d}", "three") and store.published(spark, root) == "two"
    store.write_text(spark, f"{root}/_published/{2:012d}", "")  # created by a writer that died
    assert store.published(spark, root) == "two"
    store.publish(spark, root, "four")
    assert store.published(spark, root) == "four"


# refreshed partitions


def test_a_batch_rewrites_its_partitions_alone(spark, tmp_path):
    root, schema, by = str(tmp_path / "r"), "id long, v long, ex long, df string", ["ex", "df"]
    rows = spark.createDataFrame([(i, i * 10, 2020 + i % 3, f"2020-0{i % 2 + 1}") for i in range(60)], schema)
    assert refresh.read_partitions(spark, root, schema).count() == 0
    assert len(refresh.write_partitions(spark, root, rows, by)) == 6
    table = lambda: refresh.read_partitions(spark, root, schema)
    prints = lambda: refresh.fingerprints(table(), ["id", "v"], by)
    before = spark.createDataFrame(prints().collect(), prints().schema)
    files = {p: p.stat().st_mtime_ns for p in Path(root, "rows").rglob("*.parquet")}
    batch = rows.where("ex = 2021").withColumn("v", F.col("v") + F.when(F.col("df") == "2020-01", 1).otherwise(0))
    assert refresh.write_partitions(spark, root, batch.repartition(3), by) == {"ex=2021/df=2020-01", "ex=2021/df=2020-02"}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items()) and table().count() == 60
    touched = batch.select(*by).distinct()
    found = refresh.proof(before, prints(), touched, by)
    assert {(r.ex, r.df): r.situacao for r in found.collect() if r.situacao != "igual"} == {(2021, "2020-01"): "alterada pelo lote"} and refresh.holds(found)
    # a change that the batch doesn't own up to
    refresh.write_partitions(spark, root, rows.where("ex = 2022 and df = '2020-01'").withColumn("v", F.lit(0).cast("long")), by)
    found = refresh.proof(before, prints(), touched, by)
    assert {(r.ex, r.df) for r in found.where("situacao = 'alterada fora do lote'").collect()} == {(2022, "2020-01")} and not refresh.holds(found)
    old = {p.name.removeprefix("__v=") for p in Path(root, "rows").glob("*/*/*")}
    assert refresh.prune(spark, root, old) == 3 and table().count() == 60
    plan = table().where("ex = 2020")._jdf.queryExecution().toString()
    assert "ex" in plan.split("PartitionFilters:")[1].split("]")[0]


# the layer


def test_layer_with_two_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda s: str(tmp_path / "shared"))
    source = tmp_path / "s.parquet"
    spark.range(20).write.parquet(str(source))
    built = []

    def rows():
        return spark.read.parquet(str(source)).selectExpr("id", "id % 2 as p")

    def outer():
        if not built:
            built.append(1)
            assert make(rows).count() == 20  # another writer, in the midst of this one
        return rows()

    def make(build):
        return store.layer(spark, "two", "1", [str(source)], build, ["p"], ["id"])

    assert sorted(r.id for r in make(outer).collect()) == list(range(20)) and make(rows).count() == 20
    base = next(p for p in Path(tmp_path, "shared", "snapledger").iterdir())
    assert len([p for p in base.iterdir() if p.is_dir() and p.name != "_whole"]) == 1
    # what a writer that died has left isn't read, and is listed
    left = next(p for p in base.iterdir() if p.is_dir() and p.name != "_whole")
    shutil.copytree(left, base / "0dead")
    assert make(rows).count() == 20 and [Path(p).name for p in store.old_states(spark, "two", "1", [str(source)])] == ["0dead"]


def test_layer_sees_a_file_of_the_same_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda s: str(tmp_path / "shared"))
    source = tmp_path / "s"
    spark.range(5).coalesce(1).write.parquet(str(source))
    make = lambda: store.layer(spark, "same", "1", [str(source)], lambda: spark.read.parquet(str(source)).selectExpr("id", "0 as p"), ["p"], ["id"])
    assert make().agg(F.sum("id")).first()[0] == 10
    spark.range(5, 10).coalesce(1).write.parquet(str(tmp_path / "o"))
    (own,), (other,) = source.glob("*.parquet"), (tmp_path / "o").glob("*.parquet")
    data = other.read_bytes()
    own.with_name(f".{own.name}.crc").unlink()
    own.write_bytes(data)
    spark.catalog.refreshByPath(str(source))
    assert make().agg(F.sum("id")).first()[0] == 35
    assert len(store.old_states(spark, "same", "1", [str(source)])) == 1
