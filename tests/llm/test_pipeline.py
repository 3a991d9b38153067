"""The pipeline's stages, each held against brute force on its own input, and on awkward tables."""

import os

import pytest
from pyspark.sql import functions as F
from test_order_minhash import brute as near_groups
from test_quality import judged
from test_suffix_dedup import brute as repeated_words

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality_rules":
            assert {r.doc_id for r in after} == {i for i, t in texts if judged(t)}
        elif name == "near_dedup":
            want = set(before) - {d for d, _ in near_groups(texts)}
            assert len({r.doc_id for r in after} ^ want) <= 0.02 * len(before)
        elif name == "substring_dedup":
            gone = repeated_words(texts, 50)
            left = {i: " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ())) for i, t in texts}
            assert {r.doc_id: " ".join(r.text.split()) for r in after} == {i: t for i, t in left.items() if t or not gone.get(i)}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {i for i, t in texts if any(x in t for x in items)}
            assert not whole & {r.doc_id for r in after} and len(after) >= len(before) - len(whole) - 2
        if name != "packing":
            assert docs.columns == columns and {r.doc_id for r in after} <= set(before)
            for r in after:
                assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        else:
            assert [w for r in sorted(after, key=lambda r: (r.shard, r.window)) for w in r.text.split()] == [w for i in sorted(before) for w in before[i].text.split()]
        seen[name] = len(after)
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES] and seen["packing"] > 0


def test_awkward_tables(spark):
    base = spark.createDataFrame([(None, "some text", "en", None, 9), (1, None, None, "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 20_000, "en", "s", None), (4, "a few words here", None, None, 16), (5, "a few words here", None, None, 16)], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = base.withColumns({c: F.lit(1) for c in ("th", "key", "keep", "hash", "spans", "a", "b", "n", "__x")})
    for table in (base, clashing, base.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), table.schema)
        ids = sorted((r.doc_id or 0) for r in docs.collect())
        assert ids == ([] if table.isEmpty() else [0, 1, 2, 2, 4])
        windows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(windows) == (0 if table.isEmpty() else 1)
