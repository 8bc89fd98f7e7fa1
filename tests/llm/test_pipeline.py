import collections

import corpus_pipeline as P


def run_stages(spark, folder, out):
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        counts.append(docs.count())
    return docs, counts


def test_stages(spark, odd_dir, tmp_path):
    before = spark.read.parquet(f"{odd_dir}/documents.parquet")
    docs, counts = run_stages(spark, odd_dir, tmp_path)
    assert docs.columns == [*before.columns, "shard_", "slot_"]
    assert counts[0] <= before.count() and counts[1] <= counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    kept = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/near_duplicates").select("doc_id").collect()]
    assert 0 in kept and not set(range(60, 86)) & set(kept)
    assert None in kept and len(kept) == len(set(kept))
    places = collections.Counter((r["shard_"], r["slot_"]) for r in docs.select("shard_", "slot_").collect())
    assert set(places.values()) <= {1}


def test_run_agrees_with_stages(spark, plain_dir, tmp_path):
    docs, _ = run_stages(spark, plain_dir, tmp_path)
    columns = ["doc_id", "shard_", "slot_"]
    assert sorted(map(tuple, P.run(spark, plain_dir).select(*columns).collect())) == sorted(map(tuple, docs.select(*columns).collect()))


def test_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).count() == 0
