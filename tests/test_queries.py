"""Every registered ledger query with SQL against DuckDB on the smallest tables, and the shape of the plans."""

import duckdb
import pytest

from snapledger import plans
from snapledger.plans.indicators import records

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("-" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    have = plain(df.select(*columns).collect())
    want = plain(duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name]})").fetchall())
    assert have == want
    assert not [c for c, t in df.dtypes if t in ("double", "float")]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned(spark):
    from snapledger.sources.ledger import commitments

    plan = plan_of(commitments(spark, SF).groupBy("entidade").count())
    line = next(x for x in plan.splitlines() if "FileScan" in x and "l_orderkey" in x)
    assert "l_comment" not in line and "l_suppkey" not in line and "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "StringStartsWith" in plan_of(plans.QUERIES["list_prefix_filter"](spark, SF))


def test_every_set_anomaly_is_counted(spark):
    found = {r.tipo: r.ocorrencias for r in plans.QUERIES["quality_profile_all"](spark, SF).collect()}
    assert {"CHAVE-DUP", "VALOR-RECUSADO", "DESCONTINUIDADE"} <= set(found)
    assert found["CHAVE-DUP"] == plans.QUERIES["dup_key_classified"](spark, SF).count()
    absent = {r.tipo for r in plans.QUERIES["types_without_occurrence_all"](spark, SF).collect()}
    assert absent | set(found) == set(plans.relations.TYPES) and not absent & set(found)


def test_queries_read_the_stored_layer_by_partition(spark):
    plan = plan_of(plans.QUERIES["list_page"](spark, SF))
    scan = [x for x in plan.splitlines() if "FileScan" in x]
    assert all("lineitem" not in x for x in scan) and any("(ex" in x.split("PartitionFilters:")[1] and "1999-12-31" in x.split("PartitionFilters:")[1] for x in scan)
    for name in ("commitment_history", "closing_check", "quality_profile", "series_across_years_dense"):
        executed = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert sum("lineitem" in x for x in executed.splitlines() if "FileScan" in x) <= 1, name


def test_a_layer_follows_its_sources(spark, tmp_path):
    import shutil

    for t in ("lineitem", "orders", "customer", "nation"):
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    before = records(spark, str(tmp_path)).count()
    assert before == records(spark, SF).count()
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas().to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    assert records(spark, str(tmp_path)).count() < before


def test_reserved_pairs_are_told_for_all_years(spark):
    at = lambda df: {(r.ex, r.df) for r in df.select("ex", "df").distinct().collect()}
    reserved = at(plans.QUERIES["pairs_reserved"](spark, "/root/testdata/sf0.01"))
    assert reserved == at(plans.QUERIES["pairs"](spark, "/root/testdata/sf0.01")) and min(reserved)[0] < plans.relations.FIRST


def test_the_ledger_takes_more_tasks_as_its_tables_grow(spark, monkeypatch):
    from snapledger.operators.rules import derive
    from snapledger.sources import ledger

    monkeypatch.setattr(ledger, "PORTION", 4096)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    parts = ledger.tasks(spark, SF)
    assert parts == ledger.portions(spark, SF) > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        wide = ledger.balances(spark, SF)
        assert wide.rdd.getNumPartitions() == parts and ledger.dealt(wide, parts).rdd.getNumPartitions() >= parts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    made = derive(ledger.at_cuts(ledger.dealt(wide, parts)))
    stored = records(spark, SF).select(*made.columns)
    assert made.exceptAll(stored).count() == stored.exceptAll(made).count() == 0 < stored.count()


def test_sums_of_movements_are_never_sent_whole(spark):
    assert "strategy=merge" in plan_of(plans.QUERIES["commitment_whole"](spark, SF))


def test_exclusivity_reads_the_pages_once_a_side(spark):
    executed = plans.QUERIES["exclusivity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x for x in executed.splitlines()) == 2
