"""Recall of the nearest vectors as the number of cells grows."""

import numpy as np
import pyarrow as pa

from sievebench.llm import neighbours


def test_recall_with_many_cells(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/vector_store.parquet")
    pdf = table.toPandas()
    rows, x = neighbours.unit_rows(pa.array(pdf["embedding"].tolist(), pa.list_(pa.float32())), 64)
    ids = pdf["vec_id"].to_numpy()[rows]
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -9)
    want = {(int(ids[i]), int(ids[j])) for i, best in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5]) for j in best}
    got = {(r["id"], r["other"]) for r in neighbours.nearest(table, cell=10).collect()}
    assert len(got & want) >= 0.9 * len(want)
