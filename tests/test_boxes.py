import math

import numpy as np
import pytest

from latticework.operators import geometry as M
from latticework.operators.boxes import box_table
from latticework.operators.selection import matrix_median
from latticework.sources.recordings import save_dataset


def box(x):
    x = np.sort(np.asarray(x, float))
    q1, m, q3 = np.quantile(x, [0.25, 0.5, 0.75], method="hazen")
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    sd = x.std(ddof=1) if len(x) > 1 else None
    half = None if sd is None else 1.96 * sd / math.sqrt(len(x))
    return (len(x), x.mean(), sd, None if sd is None else x.mean() - half, None if sd is None else x.mean() + half, q1, m, q3, inside.min(), inside.max(), len(x) - len(inside))


def test_boxes_of_odd_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=101), "b": np.r_[rng.normal(size=50), 40.0, -40.0, 41.0], "one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 9 + [6.0], None: [1.0, 2.0, 4.0, 8.0]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("b", float("nan")), ("nulls", None)]
    got = {r["grp"]: tuple(r)[1:] for r in box_table(spark.createDataFrame(rows, "grp string, v double"), "v", ["grp"]).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(box(x), abs=1e-9), k
    assert box_table(spark.createDataFrame([], "grp string, v double"), "v", ["grp"]).count() == 0


def test_median_of_whole_matrices(spark):
    rng = np.random.default_rng(1)
    rows, cells = [], {0: [], 1: []}
    for unit, n in ((0, 5), (1, 4), (2, 5)):
        a = np.triu(rng.normal(size=(n, n)), 1)
        rows += [(unit % 2, unit, i, j, float(a[i, j])) for i in range(n) for j in range(i + 1, n)]
        cells[unit % 2] += (a + a.T).ravel().tolist()
    got = {r["grp"]: r["median"] for r in matrix_median(spark.createDataFrame(rows, "grp int, unit int, i int, j int, w double"), ["grp", "unit"], ["grp"]).collect()}
    assert got == pytest.approx({g: float(np.median(c)) for g, c in cells.items()})


def test_points_are_scaled_turned_and_moved(spark):
    m = M.placement((1, 2, 3), (0, 0, math.pi / 2), (2, 1, 1))
    one = M.transformed(spark.createDataFrame([("c", 1.0, 0.0, 5.0, 9)], "channel string, x double, y double, z double, other int"), m).first()
    assert tuple(one) == ("c", pytest.approx(1.0), pytest.approx(4.0), pytest.approx(8.0), 9)
    turned = M.placement(turn=(math.pi / 2, 0, math.pi / 2)) @ [1, 0, 0, 1]  # z first: to +y; x then lifts it to +z
    assert np.allclose(turned, [0, 0, 1, 1]) and np.allclose(M.placement(turn=(0, math.pi / 2, 0)) @ [0, 0, 1, 1], [1, 0, 0, 1])
    r = M.placement((0, 0, 0), (0.3, -0.7, 1.1))[:3, :3]
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)


def test_stages_lie_beside_each_other(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "subject int, value double")
    base = str(tmp_path / "set")
    where = save_dataset(rows((0, 1.0), (1, 2.0)), base, "orig")
    save_dataset(rows((1, 3.0)), base, "orig")
    save_dataset(rows((1, 9.0)), base, "epochs", "Cz")
    assert sorted((r["subject"], r["value"], r["reference"]) for r in spark.read.parquet(where).collect()) == [(0, 1.0, "REFCZ"), (1, 3.0, "REFCZ")]
    assert [(r["value"], r["reference"]) for r in spark.read.parquet(f"{base}_epochs").collect()] == [(9.0, "Cz")]
