"""What the exact neighbour search stores and sends grows as the rows, not as rows times cells."""

import numpy as np
import pytest

from folioscope.plans import neighbours


def rows_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>")


@pytest.mark.parametrize("group_rows", [16384, 64])
def test_rows_are_sent_to_groups_of_cells(spark, monkeypatch, group_rows):
    """In many dimensions every cell is open to every point; each point is stored once all the same."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", group_rows)
    stored, kept = {}, neighbours._kept

    def counted(df, label):
        out = kept(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(neighbours, "_kept", counted)
    x = np.random.default_rng(5).integers(-9, 10, (400, 24)).astype(float)
    x[:90] = x[0]
    df = rows_of(spark, x)
    found = neighbours.nearest_to_points(df, df, "key", "vector", 6, exclude_self=True).collect()
    assert stored["asked"] <= len(x)
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(distance, np.inf)
    got = {}
    for r in sorted(found, key=lambda r: (r["key"], r["rank"])):
        got.setdefault(r["key"], []).append(r["neighbour"])
    for i in range(len(x)):
        assert got[i] == list(np.lexsort((np.arange(len(x)), distance[i]))[:6])
