"""Grouped kernels see whole groups, however batches cut them."""

import numpy as np

from rasterloom.operators.groups import by_key


def test_groups_across_batches(spark):
    rows = [(k, i, (k * 31 + i) % 7) for k in range(40) for i in range(k)]
    df = spark.createDataFrame(rows, "k bigint, i int, v int").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.k: (r.n, r.s) for r in by_key(df, "k", "i", ["i", "v"], lambda p: [(len(p), int((p[:, 0] * p[:, 1]).sum()))], "n bigint, s bigint", ["n", "s"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: (k, sum(i * ((k * 31 + i) % 7) for i in range(k))) for k in range(1, 40)}
    assert by_key(df.limit(0), "k", "i", ["v"], lambda p: [(int(np.sum(p)),)], "s bigint", ["s"]).count() == 0
