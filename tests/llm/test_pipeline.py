import zlib

import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline_stages(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, odd_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: sorted(r["doc_id"] for r in df.where("doc_id is not null").collect()) for name, df in seen.items()}
    assert not {100, 101, 102, 103} & set(ids["language"]) and len(ids["language"]) == 19
    kept = ids["near_dedup"]
    assert 104 in kept and 105 not in kept and kept.count(109) == 1 and len(set(kept)) == len(kept)
    assert {106, 107} & set(kept) <= {106}
    text = seen["pii"].where("doc_id = 108").first()
    assert text["text"].startswith("Mail [EMAIL] or [PHONE]; card [CARD] and [IP] é") and text["n_chars"] == len(text["text"])
    assert set(ids["mixing"]) == set(kept) and max(ids["mixing"].count(i) for i in kept) <= 2
    assert set(ids["packing"]) == set(kept)


def test_run_and_empty(spark, odd_dir, empty_dir):
    assert corpus_pipeline.run(spark, odd_dir).agg(F.sum("length")).first()[0] > 9000
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert zlib.crc32(b"") == 0
