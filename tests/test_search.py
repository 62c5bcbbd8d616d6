"""The registered search draws and scores all its trials; fits are replaced, trials, cells and folds are not."""

from math import prod

import duckdb
import pytest

import __spark_entry__ as entry
from labelwatch.operators import rounds
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def fits(monkeypatch):
    asked = []

    def scores(dealt, estimator, metric, folds):
        asked.append((estimator, folds, dealt))
        return [1.0] * folds

    monkeypatch.setattr(rounds, "fold_scores", scores)
    return asked


def test_search_has_all_trials_cells_and_folds(spark, fits):
    found = entry.queries()["random_search"](spark, FOLDER).collect()
    for learner, space in rounds.SEARCH_SPACES.items():
        own = [r for r in found if r["learner"] == learner]
        assert sorted(r["trial"] for r in own) == list(range(50)) and len({r["cell"] for r in own}) == 50
        assert all(0 <= r["cell"] < prod(map(len, space.values())) for r in own)
        for r in own:
            assert r["params"] == {k: str(x) for k, x in rounds.cell_params(space, r["cell"]).items()}
    assert len(fits) == 150 and {folds for _, folds, _ in fits} == {5}
    assert {r["fold"] for r in fits[0][2].select("fold").distinct().collect()} == set(range(5))
    trees = {e.getNumTrees() if e.hasParam("numTrees") else e.getMaxIter() for e, _, _ in fits}
    assert trees == {100, 300, 500}


def test_search_plan_matches_sql(spark, fits):
    got = entry.queries()["search_plan"](spark, FOLDER).toPandas()
    want = duckdb.connect().execute(entry.oracle_sql()["search_plan"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(fits) == 150
