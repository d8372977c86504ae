"""Picks the prior and the number of epochs of the toxicity machine by a split inside the permitted rows alone.

    python -m tests.llm.tune_toxicity /root/testdata/sf0.1 ...

Of the labelled rows outside the held-out fold, two of seven parts are kept for validation; nothing of the held-out fold is read.
"""

from __future__ import annotations

import sys
from concurrent.futures import ProcessPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from chatlake.llm import toxicity_fm as X
from chatlake.llm.learning import fold

PRIORS = {"loose": ((1e-2, 1e-2), (1e-5, 1e-5)), "middle": ((0.1, 0.03), (1e-4, 1e-4)), "tight": ((0.3, 0.1), (1e-4, 1e-4)), "tighter": ((1.0, 0.3), (1e-3, 1e-3))}
EPOCHS = (10, 20, 30, 45, 60)


def one(job):
    prior, epochs, own, other = job
    X.NEUTRAL = PRIORS[prior]
    model = X.train(*own, epochs)
    p = np.clip(model.score(other[0], other[1]), 1e-6, 1 - 1e-6)
    y = other[2]
    hit = p >= X.THRESHOLD
    return prior, epochs, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum()), int(y.sum()), len(y)


def taken(bucket, first, label, rows):
    n = np.diff(first)[rows]
    at = np.repeat(first[:-1][rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return bucket[at], np.concatenate([[0], np.cumsum(n)]), label[rows]


def main() -> None:
    from chatlake.session import get_spark

    spark = get_spark("tune")
    spark.sparkContext.setLogLevel("ERROR")
    jobs, names = [], []
    for path in sys.argv[1:]:
        found = X.sample(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
        rows = spark.createDataFrame([(int(d),) for d in found.doc_id], "d long").select("d", (fold(F.col("d"), 7) < 2).alias("v")).collect()
        apart = {r["d"] for r in rows if r["v"]}
        check = np.array([d in apart for d in found.doc_id])
        own, other = (taken(found.bucket, found.first, found.label, np.flatnonzero(k)) for k in (~check, check))
        jobs += [(p, e, own, other) for p in PRIORS for e in EPOCHS]
        names += [path] * (len(PRIORS) * len(EPOCHS))
    spark.stop()
    with ProcessPoolExecutor(8) as pool:
        for name, (prior, epochs, loss, hits, wrong, positive, n) in zip(names, pool.map(one, jobs), strict=True):
            print(f"{name} {prior} {epochs} epochs: log loss {loss:.4f}, {hits} of {positive} toxic found, {wrong} of {n - positive} clean", flush=True)


if __name__ == "__main__":
    main()
