"""Every stage of the pipeline against brute force, and on odd rows."""

from test_operators import ROWS, SCHEMA, SF, brute_components, brute_exact, brute_fingerprint, check_packing

import corpus_pipeline
from snapledger.llm import quality


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]

    good = written(spark, stages["quality classifier"](spark, docs, SF), tmp_path / "1")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model)
    before = docs.toPandas()
    want = before[[scorer.score(t) >= quality.THRESHOLD for t in before.text]]
    assert good.columns == names and sorted(good.toPandas().doc_id) == sorted(want.doc_id)

    unique = written(spark, stages["exact dedup"](spark, good, SF), tmp_path / "2")
    rows = want[["doc_id", "text"]].values.tolist()
    keep = {v[0] for v in brute_exact([tuple(r) for r in rows]).values()}
    assert unique.columns == names and sorted(unique.toPandas().doc_id) == sorted(keep)

    apart = written(spark, stages["near dedup"](spark, unique, SF), tmp_path / "3")
    left = want[want.doc_id.isin(keep)].sort_values("doc_id")
    roots = set(brute_components([brute_fingerprint(t) for t in left.text]))
    assert sorted(apart.toPandas().doc_id) == [i for k, i in enumerate(left.doc_id) if k in roots]

    mixed = written(spark, stages["mixing"](spark, apart, SF), tmp_path / "4")
    again = stages["mixing"](spark, apart, SF).toPandas()
    assert sorted(mixed.toPandas().doc_id) == sorted(again.doc_id) and mixed.columns == names and mixed.toPandas().doc_id.value_counts().max() <= 2

    last = stages["packing"](spark, mixed, SF)
    check_packing([r.asDict() | {"__id": r["doc_id"]} for r in last.collect()], mixed.toPandas()[["doc_id", "text"]].values.tolist())
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.toPandas()[key].values.tolist())) == sorted(map(tuple, last.toPandas()[key].values.tolist()))


def test_stages_on_odd_rows(spark, tmp_path):
    odd, none = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, none, SF).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
        assert out.count() >= (0 if name == "quality classifier" else 1)
