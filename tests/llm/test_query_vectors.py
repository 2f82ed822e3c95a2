"""A repeated query id is asked with a usable vector if it has one."""

from pyspark.sql import functions as F

from tidemark.llm import topk


def test_unusable_rows_of_a_query_id_are_passed_over(spark):
    inf, nan = float("inf"), float("nan")
    bad = {0: [], 100: [None, 1.0], 200: [-inf, 1.0], 300: [-9.0, nan], 400: [-9.0, inf], 500: [-9.0, None]}
    rows = [(i, x) for i, x in bad.items()] + [(i, [1.0, 0.5]) for i in bad] + [(600, [nan, 1.0]), (7, [1.0, 1.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(i, 7) for i in bad}


def test_bounds_prune_smooth_vectors_and_none_of_independent_ones():
    """Exact whatever is pruned; the share that is depends on how components go together."""
    import numpy as np
    import pyarrow.parquet as pq

    from tidemark.llm import topk

    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.standard_normal((3000, 8)), 8, axis=1) * 1024 + rng.standard_normal((3000, 64)) * 20
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"])["embedding"].combine_chunks()
    own = np.floor(1024 * table.flatten().to_numpy().reshape(len(table), -1).astype(float))
    for x, low, high in ((np.floor(smooth), 0.0, 0.05), (own, 0.9, 1.0)):
        ids = np.arange(len(x))
        best = topk.Best(ids[::100], x[::100], 10)
        for at in range(0, len(x), 256):
            best.meet(ids[at : at + 256], x[at : at + 256])
        scores = x[::100] @ x.T
        scores[np.arange(len(ids[::100])), ids[::100]] = -np.inf
        want = [[(s, -i) for s, i in sorted(((s, -i) for i, s in enumerate(row)), reverse=True)[:10]] for row in scores]
        assert [[(s, v) for s, v in zip(a, b, strict=True)] for a, b in zip(best.score, best.vec, strict=True)] == want
        assert low <= best.pairs[-1] / best.pairs[0] <= high, best.pairs
        print(best.pairs / best.pairs[0])
