"""The pipeline's stages, one after another, each against a plain version of what it decides."""

import corpus_pipeline as cp
import plain_versions as plain


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "sharding"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count() and all(before[i] == t for i, t in after.items())
        if name == "near_duplicates":
            classes = plain.near_classes(list(before.items()), 5, 80)
            assert set(after) == {i for i, c in classes.items() if i == c}
        if name == "decontamination":
            leaks = {i for i, t in before.items() for _, b in bench if b in t}
            assert leaks == set(before) - set(after)
        if name == "mixture":
            assert 0.5 * len(before) < len(after) < len(before)
        if name == "sharding":
            assert set(after) == set(before) and {r.shard for r in docs.select("shard").distinct().collect()} == set(range(8))
        else:
            assert docs.columns == columns
        before = after


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and {"shard", "slot", "text"} <= set(out.columns)
