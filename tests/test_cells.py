"""The vector index in cells against a scan of all vectors."""

import numpy as np

from casemill.operators import retrieval as R
from casemill.operators.cells import VectorCells


def test_cells_equal_a_scan_and_read_a_part(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 1500)] + 0.05 * rng.normal(size=(1500, 12))
    x[:400] = x[0]  # a crowd of equal vectors
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(9000, None, 1)], "vec_id long, embedding array<double>, label int")
    queries = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate((0, 500, 900, 1400, 7))] + [(9, rng.normal(size=12).tolist())], "query_id int, q array<double>")
    index = VectorCells(spark, str(tmp_path / "v"))
    assert index.search(queries, 5).collect() == []
    index.build(vectors)
    rows = lambda f: sorted(map(tuple, f.select("query_id", "rank", "id", "score").collect()))
    full = vectors.filter("embedding is not null")
    assert rows(index.search(queries, 6)) == rows(R.cosine_top(full, queries, 6))
    near = queries.filter("query_id in (1, 2, 3)")
    assert rows(index.search(near, 6)) == rows(R.cosine_top(full, near, 6))
    read, all_of_them = index.read_cells
    assert read <= 0.3 * all_of_them and all_of_them >= 3 * 30
    assert rows(index.search(queries, 6, filters={"label": 2})) == rows(R.cosine_top(full, queries, 6, filters={"label": 2}))
    assert rows(index.search(queries, 2000)) == rows(R.cosine_top(full, queries, 2000))
    assert index.search(queries.limit(0), 3).collect() == [] and index.build(vectors.limit(0)).search(queries, 3).collect() == []
