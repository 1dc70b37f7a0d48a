"""Chunks are what the model sees, not what Spark is handed."""

import pandas as pd


def test_one_frame_a_batch(spark):
    from tessera.plans import datasets

    sizes = []
    frame = pd.DataFrame({"t": ["a" * (i % 5 + 1) for i in range(20)], "len": [1] * 20})
    df = spark.createDataFrame(frame.assign(len=frame["len"].astype("int32"))).coalesce(1)
    out = datasets.chunked_scores(df, ["t"], lambda f: sizes.append(len(f)) or [float(len(x) * (len(f) <= 7)) for x in f["t"]], "len", 2, size=7)
    assert sorted(r["rm_scores"][0] for r in out.collect()) == sorted(float(i % 5 + 1) for i in range(20))
