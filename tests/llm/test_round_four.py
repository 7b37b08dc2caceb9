"""What the workers of the pipeline keep between batches."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T

from artifactlake.llm.common import annotate


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_workers_give_back_what_they_freed(spark):
    """Few small objects that stay must not hold the pages of the many that were freed."""
    pinned = []

    def make(raw, at):
        before = int(re.search(r"\nRss:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
        many = [bytes(1000) for _ in range(200_000)]
        pinned.append(many[::1000])
        return [np.full(len(at) - 1, before, np.int64)]

    docs = spark.createDataFrame([(i, "x" * 600_000) for i in range(6)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        sizes = [r["mb"] for r in annotate(docs, T.StructType([T.StructField("mb", T.LongType())]), make, keep=["doc_id"]).orderBy("doc_id").collect()]
    finally:
        spark.conf.set(name, old)
    assert max(sizes[1:]) - sizes[0] < 100, sizes
