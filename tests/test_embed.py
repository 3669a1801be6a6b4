"""Pooling by hand, and a stand-in encoder through extraction, storage and one layer's read."""

import numpy as np
import pytest

from sparkgauge.operators import embed


def states(values, attention, special):
    h = np.array(values, dtype=float).reshape(2, 1, 5, 1)
    return embed.States(h, np.array([attention]), np.array([special]), np.array([False]))


def test_pooling():
    s = states([[9, 2, 4, 9, 100], [8, 5, 7, 8, 100]], [1, 1, 1, 1, 0], [1, 0, 0, 1, 0])
    p = embed.pool(s)
    assert p["mean"].ravel().tolist() == [3.0, 6.0] and p["first"].ravel().tolist() == [9.0, 8.0]
    with pytest.raises(ValueError):
        embed.pool(states([[1] * 5, [1] * 5], [1, 1, 0, 0, 0], [1, 1, 0, 0, 0]))


def stand_in():
    def build():
        import numpy as np

        from sparkgauge.operators.embed import States

        def encode(texts):
            n = max(len(t) for t in texts)
            code = np.array([[ord(t[i]) if i < len(t) else 0 for i in range(n)] for t in texts], dtype=float)
            keep = (code > 0).astype(int)
            return States(np.stack([code[:, :, None], 2 * code[:, :, None]]), keep, np.zeros_like(keep), np.zeros(len(texts), dtype=bool))

        return encode

    return build


def test_extract_and_store(spark, tmp_path):
    df = spark.createDataFrame([("i1", "ab"), ("i2", "c"), ("i3", None)], "item_id string, text string")
    embed.extract(df, stand_in()).write.partitionBy("pooling", "layer").parquet(str(tmp_path / "e"))
    items = df.where("text is not null").select("item_id")
    got = {r["item_id"]: r["x"] for r in embed.layer_points(spark, str(tmp_path / "e"), 1, "mean", items).collect()}
    assert got == {"i1": [195.0], "i2": [198.0]}
    back = spark.read.parquet(str(tmp_path / "e"))
    assert all(r["violations"] == 0 for r in embed.store_checks(back, items, 2, 1).collect())
    with pytest.raises(ValueError):
        embed.layer_points(spark, str(tmp_path / "e"), 1, "mean", df.select("item_id"))
    plan = embed.read_layers(spark, str(tmp_path / "e"), 1, "mean")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
