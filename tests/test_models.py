"""Fitted trees: attributions of every member and the vote, samples in many partitions, the removal loop."""

import itertools
from dataclasses import replace
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwatch.operators import models, rounds, scoring, tree_paths
from labelwatch.operators.importance import permutation_importance, shuffled
from labelwatch.operators.splitting import stratified_halves, stratified_sample, stratified_split
from labelwatch.sources.views import LabelledTable


@pytest.fixture(scope="module")
def table(spark):
    u = lambda tag: F.pmod(F.xxhash64(F.lit(tag), "id"), F.lit(1000)).cast("double")
    frame = spark.range(900).withColumns({"a": u("a"), "b": u("b"), "c": u("c")}).withColumn(
        "label", (F.col("a") + F.col("b") / 4 > 600).cast("int"))
    return stratified_split(LabelledTable(frame, ("a", "b", "c"), "made", id_col="id", label_col="label"))


def brute(x, background, score):
    """Shapley values from their definition, over all subsets."""
    n, out = len(x), np.zeros(len(x))
    for row in background:
        for i in range(n):
            rest = [j for j in range(n) if j != i]
            for size in range(n):
                for chosen in itertools.combinations(rest, size):
                    with_i, without = row.copy(), row.copy()
                    with_i[[*chosen, i]] = x[[*chosen, i]]
                    without[list(chosen)] = x[list(chosen)]
                    weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                    out[i] += weight * (score(with_i[None])[0] - score(without[None])[0])
    return out / len(background)


def random_paths(rng, boosted, n_leaves=12, n_features=3):
    """Leaves with one to all of the features on their path; the last one has none."""
    entries, first = [], [0]
    for _ in range(n_leaves - 1):
        for f in sorted(rng.choice(n_features, rng.integers(1, n_features + 1), replace=False)):
            low, high = np.sort(rng.random(2))
            entries.append((f, -np.inf if rng.random() < 0.3 else low, high))
        first.append(len(entries))
    f, low, high = map(np.array, zip(*entries))
    return tree_paths.TreePaths(f, low, high, np.array([*first, first[-1]]), rng.normal(size=n_leaves), np.zeros(n_leaves), 12, 1, boosted)


def plain_score(paths, x):
    out = []
    for row in x:
        leaves = [slice(a, b) for a, b in zip(paths.first, paths.first[1:])]
        out.append(sum(v for v, s in zip(paths.value, leaves) if all(
            lo < row[f] <= hi for f, lo, hi in zip(paths.feature[s], paths.low[s], paths.high[s]))))
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_margin_parts_match_the_definition(seed):
    rng = np.random.default_rng(seed)
    paths, x, background = random_paths(rng, True), rng.random((5, 3)), rng.random((4, 3))
    p = lambda m: 1 / (1 + np.exp(-2 * m))
    assert np.allclose(paths.score(x), plain_score(paths, x), atol=1e-12)
    got = tree_paths.margin_shapley(x, background, paths)
    for row, own in zip(x, got):
        want = np.zeros(3)
        for other in background:
            m, n = paths.score(row[None])[0], paths.score(other[None])[0]
            ratio = (p(m) - p(n)) / (m - n) if m != n else 2 * p(m) * (1 - p(m))
            want += brute(row, other[None], paths.score) * ratio
        assert np.allclose(own, want / len(background), atol=1e-12)
    assert np.allclose(got.sum(1), p(paths.score(x)) - p(paths.score(background)).mean(), atol=1e-9)


@pytest.mark.parametrize("cells", [1, 10**6])
def test_probability_parts_match_the_definition(monkeypatch, cells):
    """One leaf at a time and many give the same."""
    monkeypatch.setattr(tree_paths, "CELLS", cells)
    rng = np.random.default_rng(9)
    paths, x, background = random_paths(rng, False, 20, 4), np.round(rng.random((6, 4)), 1), np.round(rng.random((5, 4)), 1)
    for row, own in zip(x, tree_paths.probability_shapley(x, background, paths)):
        assert np.allclose(own, brute(row, background, paths.score), atol=1e-12)


def hand_made_nodes(spark):
    """Tree 0: a chain of three cuts, twice on feature 0; tree 1: a single leaf."""
    rows = [(0, 0, 1, 2, 0, 5.0, 6.0, 4.0), (0, 1, 3, 4, 1, 1.0, 3.0, 4.0), (0, 2, -1, -1, -1, None, 3.0, 0.0),
            (0, 3, -1, -1, -1, None, 2.0, 0.0), (0, 4, 5, 6, 0, 2.0, 1.0, 4.0), (0, 5, -1, -1, -1, None, 1.0, 0.0),
            (0, 6, -1, -1, -1, None, 0.0, 4.0), (1, 0, -1, -1, -1, None, 5.0, 5.0)]
    return spark.createDataFrame([(*r, float(r[7] > r[6])) for r in rows],
                                 "tree int, id int, left int, right int, feature int, cut double, n0 double, n1 double, prediction double")


def test_paths_and_depths_of_a_hand_made_forest(spark):
    nodes = hand_made_nodes(spark)
    paths = tree_paths.tree_paths(nodes)
    leaves = {tuple((int(paths.feature[e]), paths.low[e], paths.high[e]) for e in range(a, b)): (v, d)
              for a, b, v, d in zip(paths.first, paths.first[1:], paths.value, paths.depth)}
    inf = np.inf
    assert leaves == {((0, 5.0, inf),): (0.0, 1), ((0, -inf, 5.0), (1, -inf, 1.0)): (0.0, 2), ((0, -inf, 2.0), (1, 1.0, inf)): (0.0, 3),
                      ((0, 2.0, 5.0), (1, 1.0, inf)): (0.5, 3), (): (0.25, 0)}
    assert (paths.n_nodes, paths.n_trees) == (8, 2)
    models.ensure_checkpoint_dir(spark)
    got = {(r.tree, r.id): r.depth for r in tree_paths.node_depths(nodes).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (0, 3): 2, (0, 4): 2, (0, 5): 3, (0, 6): 3, (1, 0): 0}
    assert models.complexity_of(nodes).first() == (2, 8, 1.5)


def test_depths_of_a_long_chain(spark):
    models.ensure_checkpoint_dir(spark)
    rows = [(0, 2 * i, 2 * i + 1, 2 * i + 2) for i in range(20)] + [(0, 2 * i + 1, -1, -1) for i in range(20)] + [(0, 40, -1, -1)]
    got = {r.id: r.depth for r in tree_paths.node_depths(spark.createDataFrame(rows, "tree int, id int, left int, right int")).collect()}
    assert got == {i: (i + 1) // 2 for i in range(41)}


def test_deep_forest_is_additive(spark, table):
    """A forest of deep trees: attributions add up to its own scores within 1e-9."""
    e = models.explain_forest(table, params={"forest": dict(numTrees=20, maxDepth=10)})
    assert e.paths.n_nodes > 400 and e.paths.depth.max() > 5
    base = models.score_models(e.background, {"forest": e.model}).agg(F.avg("p_forest")).first()[0]
    sums = e.attributions.groupBy("id").agg(F.sum("attribution").alias("total"))
    scores = models.score_models(e.sample, {"forest": e.model}).select(F.col("id").cast("string").alias("id"), "p_forest")
    worst = sums.join(scores, "id").agg(F.max(F.abs(F.col("total") - F.col("p_forest") + base))).first()[0]
    assert worst < 1e-9


def test_members_and_vote_are_additive_in_many_tasks(spark, table):
    rows = {r["member"]: r for r in models.member_additivity(table).collect()}
    assert set(rows) == {*models.MODELS, "ensemble"}
    n_test = table.frame.filter("split = 'test'").count()
    assert all(r["additive"] and r["n_rows"] == n_test for r in rows.values())
    found = models.explain_members(table, names=("boosted_wide",)).attributions
    assert found.select(F.spark_partition_id()).distinct().count() > 1


SPACES = {"forest": {"numTrees": (2, 3), "maxDepth": (2, 3), "minInstancesPerNode": (1, 4)}, "boosted_wide": {"maxIter": (1, 2), "maxDepth": (1, 2)}}


def test_removal_drops_the_leading_feature_of_the_vote(table):
    curve = rounds.progressive_removal(table, target=0.5).orderBy("iteration").collect()
    assert curve[0]["top_feature"] == "a" and curve[1]["n_features"] == 2
    assert [r["hyperparameter_regime"] for r in curve] == ["static"] * len(curve)
    assert all(0 <= r["f1"] <= 1 and -1 <= r["mcc"] <= 1 and r["fit_seconds"] > 0 and r["attribution_seconds"] > 0 for r in curve)
    assert curve[0]["mean_tree_depth"] >= curve[0]["mean_leaf_depth"] > 0


def test_a_killed_removal_goes_on(table, tmp_path, monkeypatch):
    """Stopped in its second round, the run keeps the first one and ends with the rows of a run in one go."""
    whole = rounds.progressive_removal(table, target=0.5, names=("forest",)).orderBy("iteration").collect()
    assert len(whole) == 2
    fits, fit = [], models.fit_base_models

    def dying(t, *more):
        fits.append(len(t.features))
        if len(fits) == 2:
            raise KeyboardInterrupt
        return fit(t, *more)
    monkeypatch.setattr(models, "fit_base_models", dying)
    store = str(tmp_path / "rounds")
    with pytest.raises(KeyboardInterrupt):
        rounds.progressive_removal(table, target=0.5, names=("forest",), store=store)
    again = rounds.progressive_removal(table, target=0.5, names=("forest",), store=store).orderBy("iteration").collect()
    assert fits == [3, 2, 2]
    seconds = ("fit_seconds", "attribution_seconds")
    plain = lambda rows: [{k: x for k, x in r.asDict().items() if k not in seconds} for r in rows]
    assert plain(again) == plain(whole)
    assert plain(rounds.progressive_removal(table, target=0.5, names=("forest",), store=store).orderBy("iteration").collect()) == plain(whole)
    assert fits == [3, 2, 2]


def test_a_removal_draws_its_explained_rows_once(table, monkeypatch):
    drawn, draw = [], models.stratified_sample
    monkeypatch.setattr(models, "stratified_sample", lambda t, *a: drawn.append(t.features) or draw(t, *a))
    rows = rounds.progressive_removal(table, target=0.5, max_removed=1, names=("forest",)).collect()
    assert len(rows) == 2 and len(drawn) == 1


def test_search_draws_no_cell_twice_and_resumes(table, tmp_path, monkeypatch):
    store = str(tmp_path / "trials")
    first = rounds.random_search(table, 2, 2, spaces=SPACES, store=store).collect()
    assert {(r.learner, r.trial) for r in first} == {(x, i) for x in SPACES for i in range(2)}
    every = rounds.random_search(table, 3, 2, spaces=SPACES, store=store).collect()
    assert all(r in every for r in first) and len(every) == 6
    assert all(len({r.cell for r in every if r.learner == x}) == 3 for x in SPACES)
    best = rounds.best_params(rounds.random_search(table, 3, 2, spaces=SPACES, store=store), SPACES)
    assert set(best) == set(SPACES) and all(best[x][k] in vals for x, space in SPACES.items() for k, vals in space.items())
    fitted = models.fit_base_models(table, params=best, names=("forest",))["forest"]
    assert fitted.getNumTrees == best["forest"]["numTrees"]


def test_a_trial_fits_each_fold_once_and_nothing_more(table, monkeypatch):
    """Scores are those of MLlib's cross validation, without its fit on all rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    fits, fit, parts, settled = [], RandomForestClassifier._fit, [], models.settled
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: fits.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(models, "settled", lambda *a: parts.append(settled(*a)) or parts[-1])
    found = rounds.random_search(table, 1, 3, spaces={"forest": SPACES["forest"]}).collect()
    dealt = models.assemble(parts[0])
    assert len(fits) == 3 and sum(fits) == 2 * dealt.count()
    metric = MulticlassClassificationEvaluator(labelCol="label", predictionCol="_y_forest", metricName="fMeasureByLabel", metricLabel=1.0)
    own = models.learner("forest", 42, rounds.cell_params(SPACES["forest"], found[0].cell))
    want = CrossValidator(estimator=own, estimatorParamMaps=[{}], evaluator=metric, numFolds=3, foldCol="fold").fit(dealt).avgMetrics[0]
    assert found[0].mean_f1 == pytest.approx(want, abs=1e-12)


def test_cells_are_numbered_in_mixed_radix():
    space = {"a": (1, 2, 3), "b": ("x", "y"), "c": (0.1, 0.2)}
    cells = [tuple(rounds.cell_params(space, i).values()) for i in range(12)]
    assert sorted(cells) == sorted(itertools.product(*space.values()))


@pytest.mark.parametrize("n", [1, 2, 7, 50, 5000])
def test_sample_keeps_null_classes_and_never_exceeds_n(spark, n):
    frame = spark.range(100).withColumn("label", F.when(F.col("id") % 10 > 2, F.lit(1)).when(F.col("id") % 10 > 0, F.lit(0)))
    whole = LabelledTable(frame, (), "nulls", id_col="id", label_col="label")
    got = stratified_sample(whole, n).frame
    sizes = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert sum(sizes.values()) == min(n, 100)
    assert n < 3 or set(sizes) == {None, 0, 1}


@pytest.mark.parametrize("n", [1, 2, 97, 400])
def test_every_row_is_donor_once_a_repeat(spark, n):
    frame = spark.range(n).withColumns({"x": F.col("id").cast("double"), "label": (F.col("id") % 2).cast("int")})
    nulls = spark.createDataFrame([(-1, -1.0, None)], "id long, x double, label int")  # no part
    got = shuffled(LabelledTable(frame.unionByName(nulls), ("x",), "made", id_col="id", label_col="label"), 3).collect()
    by_rep = [{r["x"]: r["_d_x"] for r in got if r["rep"] == rep} for rep in range(3)]
    assert len(got) == 3 * n and all(set(m) == set(m.values()) == {float(i) for i in range(n)} for m in by_rep)
    if n > 90:
        assert by_rep[0] != by_rep[1] != by_rep[2]
        assert all(sum(x == y for x, y in m.items()) < n / 10 for m in by_rep)


def test_permutation_importance_scores_every_row_by_the_other_half(spark):
    """Against rows scored one by one; every row takes part and none is scored by a fit it was part of."""
    u = lambda tag: F.pmod(F.xxhash64(F.lit(tag), "id"), F.lit(1000)).cast("double")
    frame = spark.range(300).withColumns({"a": u("a"), "b": u("b")}).withColumn("label", (F.col("a") + F.col("b") / 4 > 600).cast("int"))
    t = stratified_halves(LabelledTable(frame, ("a", "b"), "made", id_col="id", label_col="label"))
    fitted = scoring.cross_fit(t)
    assert fitted.scorers["a"] == scoring.fit_linear(t.where(F.col("half") == "b")) != fitted.scorers["b"]
    cells = [r.asDict() for r in shuffled(t, 2, 42, "half").collect()]
    assert len(cells) == 2 * 300 and {r["id"] for r in cells} == set(range(300))

    def loss(r):
        s = fitted.scorers[r["half"]]
        score = sum(s.weights[f] * (r[f] - s.centres[f]) / s.spreads[f] for f in t.features)
        p = min(max(1 / (1 + np.exp(-score)), 1e-15), 1 - 1e-15)
        return -np.log(p if r["label"] == 1 else 1 - p)

    for r in permutation_importance(t, fitted, n_repeats=2, carry=["half"]).collect():
        f = r["feature"]
        reps = [np.mean([loss({**c, f: c[f"_d_{f}"]}) - loss(c) for c in cells if c["rep"] == rep]) for rep in (0, 1)]
        assert abs(r["importance"] - np.mean(reps)) < 1e-5


def test_registered_permutation_importance_covers_all_rows(spark, monkeypatch):
    from labelwatch.catalog import agreement
    from labelwatch.operators import importance

    folder, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(importance, "shuffled", lambda *a, **k: asked.append(shuffled(*a, **k)) or asked[-1])
    agreement.QUERIES["permutation_importance"](spark, folder)
    rows = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert {r["rep"]: r["count"] for r in asked[0].groupBy("rep").count().collect()} == dict.fromkeys(range(5), rows)


def test_importance_of_the_vote_against_rows_scored_one_by_one(spark, table):
    fitted = models.fit_base_models(table)
    got = {r["feature"]: r for r in models.vote_importance(table, fitted, n_repeats=2).collect()}
    test = table.where(F.col("split") == "test")
    cells = [r.asDict() for r in shuffled(test, 2).collect()]

    def losses(rows):
        frame = spark.createDataFrame([(i, r["label"], r["a"], r["b"], r["c"]) for i, r in enumerate(rows)], "id long, label int, a double, b double, c double")
        p = {r["id"]: r["p_ensemble"] for r in models.score_models(replace(table, frame=frame), fitted).collect()}
        return np.array([-np.log(p[i] if r["label"] == 1 else 1 - p[i]) for i, r in enumerate(rows)])

    whole = losses(cells)
    for f in table.features:
        rise = losses([{**r, f: r[f"_d_{f}"]} for r in cells]) - whole
        reps = [rise[[r["rep"] == rep for r in cells]].mean() for rep in (0, 1)]
        assert abs(got[f]["importance"] - np.mean(reps)) < 1e-9
        assert abs(got[f]["importance_std"] - np.std(reps, ddof=1)) < 1e-9
    assert got["a"]["importance"] > got["b"]["importance"] > abs(got["c"]["importance"])
