"""Encoded noise is incompressible at every length that has a band."""

import base64
import random

import pytest
import zstandard

from orrery.llm.quality_rules import LEVEL, TIGHT_BANDS, band, measure


@pytest.mark.parametrize("n", [128, 191, 192, 255, 256, 511, 512, 1023, 1024, 2047, 2048, 3000, 4095, 4096, 5119, 20000])
def test_encoded_noise(n):
    rnd, compress = random.Random(n), zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
    for _ in range(50):
        ratio, _, chunks, _, high = measure(base64.b64encode(rnd.randbytes(n))[:n], compress, TIGHT_BANDS)
        assert ratio > band(n, TIGHT_BANDS)[1] and high == chunks


def test_query_and_pipeline_reject_it(spark, tmp_path):
    import corpus_pipeline
    from orrery.llm.queries import op5_quality_rules

    rnd = random.Random(0)
    rows = [(n, base64.b64encode(rnd.randbytes(n))[:n].decode()) for n in (128, 300, 700, 1500, 3000, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.reason for r in op5_quality_rules(spark, str(tmp_path)).collect()} == {"incompressible"}
    assert corpus_pipeline.quality(spark, df, str(tmp_path)).count() == 0
