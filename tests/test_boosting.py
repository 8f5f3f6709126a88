"""Second-order boosting against a plain booster, its penalties, saving, and layout."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from avalista.plans import boosting as b

c = F.col


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=400), r.integers(0, 2, 400), np.round(r.exponential(size=400), 1), r.normal(size=400)])
    y = (r.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + x[:, 1] - x[:, 2])))).astype(float)
    w = np.where(y == 1, 3.0, 1.0)
    rows = [(i, Vectors.dense(v), float(t), float(10 * v[0] + v[2]), float(u)) for i, (v, t, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["id", "features", "y", "z", "w"]).repartition(3), x, y, 10 * x[:, 0] + x[:, 2], w


def plain(x, y, w, cuts, classifier, trees, step, depth, gain, leaf, alpha, reg_lambda, delta):
    """The same booster over all rows at once, node by node."""
    m = np.zeros(len(y)) if classifier else np.full(len(y), (w * y).sum() / w.sum())

    def weight(g, h):
        v = -np.sign(g) * max(abs(g) - alpha, 0) / (h + reg_lambda)
        return min(max(v, -delta), delta) if delta else v

    def saved(g, h):
        v = weight(g, h)
        return -2 * (g * v + 0.5 * (h + reg_lambda) * v * v + alpha * abs(v))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = (w * (p - y), w * p * (1 - p)) if classifier else (w * (m - y), w)
        out = np.zeros(len(y))

        def grow(rows, left):
            best = (gain, None)
            for f in range(x.shape[1]) if left else ():
                for q in cuts[f]:
                    a, z = rows[x[rows, f] <= q], rows[x[rows, f] > q]
                    if not len(a) or not len(z) or min(h[a].sum(), h[z].sum()) < leaf:
                        continue
                    s = saved(g[a].sum(), h[a].sum()) + saved(g[z].sum(), h[z].sum()) - saved(g[rows].sum(), h[rows].sum())
                    if s > best[0] * (1 + 1e-9):
                        best = (s, (a, z))
            if best[1] is None:
                out[rows] = weight(g[rows].sum(), h[rows].sum())
            else:
                for part in best[1]:
                    grow(part, left - 1)

        grow(np.arange(len(y)), depth)
        m = m + step * out
    return m


PENALTIES = [
    {"gain": 0.2, "leaf": 5, "alpha": 1.0, "reg_lambda": 2.0, "delta": 1.0},
    {"gain": 0.0, "leaf": 1, "alpha": 0.0, "reg_lambda": 1.0, "delta": 0.0},
    {"gain": 3.0, "leaf": 20, "alpha": 0.5, "reg_lambda": 0.1, "delta": 0.3},
]


@pytest.mark.parametrize("classifier", [True, False])
@pytest.mark.parametrize("penalties", PENALTIES)
def test_equal_to_a_plain_booster(data, monkeypatch, classifier, penalties):
    monkeypatch.setattr(b, "FOLD", 3)  # margins are folded in between
    rows, x, y, z, w = data
    size = {"trees": 8, "step": 0.3, "depth": 3}
    model = b.fit_boosted(rows, "y" if classifier else "z", "w", classifier, **size, **penalties, bins=16)
    want = plain(x, y if classifier else z, w, b.feature_cuts(rows, 16), classifier, **size, **penalties)
    assert np.allclose(model.margins(x), want, atol=1e-8)
    out = model.setPredictionCol("k").transform(rows).orderBy("id")
    if classifier:
        got = [r.p for r in out.select(vector_to_array("probability")[1].alias("p")).collect()]
        assert np.allclose(got, 1 / (1 + np.exp(-want)))
    else:
        assert np.allclose([r.k for r in out.collect()], want)


def test_penalties_hold_back_the_leaves(data):
    rows, *_ = data
    size = {"trees": 1, "step": 1.0, "depth": 4}
    free = b.fit_boosted(rows, "y", "w", True, **size, reg_lambda=0.0, leaf=0)
    held = b.fit_boosted(rows, "y", "w", True, **size, **PENALTIES[0])
    assert len(held.trees[0].feature) < len(free.trees[0].feature) and np.abs(held.trees[0].value).max() <= 1 < np.abs(free.trees[0].value).max()


def test_draws_saving_and_importance(data, spark, tmp_path):
    rows, x, *_ = data
    fit = lambda: b.fit_boosted(rows, "y", "w", True, 6, 0.2, 3, rows=0.7, columns=0.5, seed=9)
    model, again = fit(), fit()
    assert np.allclose(model.margins(x), again.margins(x))  # draws depend on the seed alone
    model.setPredictionCol("k").write().overwrite().save(str(tmp_path / "m"))
    loaded = b.BoostedTrees.load(str(tmp_path / "m"))
    assert np.array_equal(loaded.margins(x), model.margins(x)) and loaded.prediction == "k"
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0


def test_many_tasks_are_added_up_in_groups(data, monkeypatch):
    rows, x, *_ = data
    one = b.fit_boosted(rows, "y", "w", True, 2, 0.3, 3)
    monkeypatch.setattr(b, "FAN_IN", 2)
    two = b.fit_boosted(rows.repartition(7), "y", "w", True, 2, 0.3, 3)
    assert np.allclose(one.margins(x), two.margins(x))


@pytest.mark.parametrize("classifier", [True, False])
def test_one_task_and_many_grow_the_same_trees(data, spark, monkeypatch, classifier):
    """Few rows take one job for many trees; more take one per level, and the driver gets no tables of sums."""
    rows, x, *_ = data
    fit = lambda: b.fit_boosted(rows, "y" if classifier else "z", "w", classifier, 4, 0.3, 3, columns=0.8, seed=5, **PENALTIES[0])
    spark.sparkContext.setJobGroup("one task", "")
    one = fit()
    spark.sparkContext.setJobGroup("many tasks", "")
    monkeypatch.setattr(b, "PART_ROWS", 128)
    many = fit()
    spark.sparkContext.setJobGroup("others", "")
    assert np.allclose(one.margins(x), many.margins(x))
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(g)) for g in ("one task", "many tasks")]
    assert jobs[0] + 8 < jobs[1]


def test_one_task_adds_up_columns_together(data):
    """One-hot features, equal columns and columns of few codes take few passes over the rows; each gets its own sums."""
    r = np.random.default_rng(8)
    kind, other = r.integers(0, 12, 500), r.integers(0, 9, 500)
    wide = r.integers(0, 200, 500)
    x = np.stack([wide, other, wide, *[kind == k for k in range(12)], r.integers(0, 2, 500), other, r.integers(0, 3, 500)]).astype(np.uint8)
    size = [200, 9, 200, *[2] * 12, 2, 9, 3]
    first = np.concatenate([[0], np.cumsum(size)])
    y, w = r.integers(0, 2, 500).astype(float), r.integers(1, 4, 500).astype(float)
    parts = [slice(0, 300), slice(300, 500)]
    blocks = [b._Block(b.pa.RecordBatch.from_arrays(
        [b.pa.array([i]), b.pa.array([len(y[s])]), *[b.pa.array([v.tobytes()], b.pa.binary()) for v in (x[:, s], y[s], w[s], np.zeros(len(y[s])))]],
        ["id", "n", "x", "y", "w", "m"]), 0, [], 0.1) for i, s in enumerate(parts)]
    rows = b._Rows(blocks, first, [], 0.1)
    assert len(rows.groups) <= 3
    used = np.array([0, 1, 2, 4, 9, 14, 15, 16, 17])
    rows.start(True, 0.7, [5, 1], (2.0**-40, 2.0**-40), used, 3)
    assert len(rows.taken) <= len(rows.groups)
    rows.node[:] = r.integers(0, 3, 500)
    got = rows.sums(np.array([1, -1, 0]), 2, sum(size[f] for f in used))
    assert 300 < len(rows.drawn) < 400
    lo = 0
    for f in used:
        want = np.zeros((2, size[f], 2))
        for i, at in enumerate(rows.drawn):
            if rows.node[at] != 1:
                want[int(rows.node[at] == 0), x[f, at]] += [v[i] for v in rows.derivatives]
        assert np.array_equal(got[:, lo : lo + size[f]], want)
        lo += size[f]


@pytest.mark.parametrize("classifier", [True, False])
def test_trees_of_many_nodes_go_down_in_one_step(data, monkeypatch, classifier):
    rows, x, *_ = data
    fit = lambda: b.fit_boosted(rows, "y" if classifier else "z", "w", classifier, 3, 0.3, 6, leaf=1, seed=5)
    one = fit()
    want = one.margins(x)
    monkeypatch.setattr(b, "FEW_NODES", 2)
    assert np.array_equal(want, one.margins(x)) and np.array_equal(want, fit().margins(x))


@pytest.mark.parametrize("classifier", [True, False])
def test_processes_that_share_the_rows_grow_the_same_trees(data, monkeypatch, classifier):
    """More rows than one process should take are shared by several, in the same one task."""
    rows, x, *_ = data
    fit = lambda: b.fit_boosted(rows, "y" if classifier else "z", "w", classifier, 12, 0.3, 4, rows=0.8, columns=0.8, seed=5, **PENALTIES[0])
    one = fit()
    monkeypatch.setattr(b, "ALONE_ROWS", 100)
    monkeypatch.setattr(b, "FOLD_ALONE", 8)
    shared = fit()
    assert np.array_equal(one.margins(x), shared.margins(x))


def test_processes_add_up_their_tables():
    crew = b._Crew(3, 4)
    sums = [crew.of_all(np.array([[float(crew.rank + turn), 1.0]])) for turn in range(5)]
    if crew.rank:
        b.os._exit(0)
    crew.end()
    assert [s.tolist() for s in sums] == [[[3.0 + 3 * turn, 3.0]] for turn in range(5)]


def test_a_process_that_ends_fails_the_others():
    crew = b._Crew(2, 4)
    if crew.rank:
        b.os._exit(1)
    with pytest.raises((RuntimeError, BrokenPipeError)):
        crew.of_all(np.zeros(2))
    crew.end()


def test_forest_of_means(data, spark, monkeypatch, tmp_path):
    """Each tree splits where the variance falls most, its leaves are means of the rows drawn, and it does not matter which process grows it."""
    rows, x, _, z, _ = data
    forest = b.fit_forest(rows, "z", 12, 4, 5, 7)
    monkeypatch.setattr(b, "_executor_cores", lambda spark: 1)
    one = b.fit_forest(rows, "z", 12, 4, 5, 7)
    assert np.array_equal(forest.margins(x), one.margins(x)) and len(forest.trees) == 12
    assert np.corrcoef(forest.margins(x), z)[0, 1] > 0.95 and z.min() <= forest.margins(x).min() and forest.margins(x).max() <= z.max()
    assert all((t.feature >= 0).any() and len(t.feature) <= 31 for t in forest.trees) and len({t.value.tobytes() for t in forest.trees}) == 12
    forest.setPredictionCol("lgd").write().overwrite().save(str(tmp_path / "f"))
    assert np.array_equal(b.BoostedTrees.load(str(tmp_path / "f")).margins(x), forest.margins(x))
    same = spark.createDataFrame([(Vectors.dense(1.0), 3.0)] * 5, ["features", "z"])
    assert np.allclose(b.fit_forest(same, "z", 3, 4, 1, 7).margins(np.ones((2, 1))), 3.0)


def test_a_tree_of_the_forest_takes_the_best_split(spark):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 20, 300).astype(float), np.zeros(300)
    y[x > 12] = 100.0
    y += r.normal(size=300)
    rows = spark.createDataFrame([(Vectors.dense(u), float(v)) for u, v in zip(x, y)], ["features", "z"])
    forest = b.fit_forest(rows, "z", 20, 1, 1, 3)
    assert {float(t.threshold[0]) for t in forest.trees} == {12.0}
    got = forest.margins(np.array([[0.0], [19.0]]))
    assert abs(got[0] - y[x <= 12].mean()) < 0.5 and abs(got[1] - y[x > 12].mean()) < 0.5
