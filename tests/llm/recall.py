"""Recall and reading of the forest on given embeddings, beside brute force: ``python -m tests.llm.recall sf0.1 check_l clusters50000``.

Prints, for each name, recall@10, the mean share of the table that a query reads, and the routes it visits.
``clustersN`` are N made vectors in N / 100 clusters, as the given ones are nearly random directions.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb
import numpy as np

from chatlake.llm import ann_forest as A


def vectors(name: str) -> np.ndarray:
    if name.startswith("clusters"):
        rng = np.random.default_rng(3)
        n = int(name.removeprefix("clusters"))
        centres = rng.normal(size=(n // 100, 64))
        return centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, 64))
    path = f"/root/testdata/{name}/embeddings.parquet"
    rows = duckdb.sql(f"SELECT embedding FROM '{path + '/*.parquet' if os.path.isdir(path) else path}' ORDER BY vec_id").fetchnumpy()
    return np.stack([np.array(v, float) for v in rows["embedding"]])


def measure(x: np.ndarray, queries: np.ndarray, k: int = 10, shard: int = A.SHARD, trees: int = A.TREES) -> tuple[float, float, float]:
    """(recall, share read, routes visited) of some rows as queries, with the operator's two searches."""
    n, dim = x.shape
    ids, centre = np.arange(n), x[: A.SAMPLE].mean(axis=0)
    bits = max(0, math.ceil(math.log2(n / shard)))
    planes = A.normals(dim, bits, 1)
    route = ((x - centre).astype(np.float32) @ planes > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    forests = {r: A.HashForest(x[route == r], ids[route == r], centre, trees) for r in np.unique(route).tolist()}
    hits = visited = 0
    for q in queries:
        found, agree = [], math.nan
        own = int(route[q])
        masks, to_all = np.zeros(0, np.int64), False
        for nth in range(2):
            todo = [own] if not nth else [r for r in forests if r != own] if to_all else [int(own ^ m) for m in masks if int(own ^ m) in forests]
            for r in todo:
                visited += 1
                for _, rows, score, a in forests[r].search(x[q : q + 1], ids[q : q + 1], k, np.array([agree])):
                    found += zip(score.tolist(), forests[r].ids[rows].tolist(), strict=True)
                    agree = agree if nth else a
            if not nth and bits:
                masks, chance = A.likely_routes(x[q] - centre, planes.astype(float), agree) if not math.isnan(agree) else (masks, 0.0)
                to_all = chance < A.ROUTED
        square = ((x - x[q]) ** 2).sum(axis=1)
        square[q] = np.inf
        hits += len({i for _, i in sorted(found)[:k]} & set(np.lexsort((ids, square))[:k].tolist()))
    return hits / (k * len(queries)), sum(f.read for f in forests.values()) / len(queries) / n, visited / len(queries)


if __name__ == "__main__":
    for name in sys.argv[1:]:
        x = vectors(name)
        print(name, "recall %.3f, share read %.3f, routes %.1f" % measure(x, np.arange(0, len(x), 100)))
