"""Random search: what is drawn, and the analysis of a trial table."""

import json
import math

from msgscope.operators import search as SE


def test_draws_stay_in_range_and_repeat():
    a, b = SE.draw(50, 1), SE.draw(50, 1)
    assert a == b != SE.draw(50, 2)
    for name, (_, low, high) in SE.SPACE.items():
        values = [float(t[name]) for t in a]
        assert low <= min(values) and max(values) <= high and len(set(values)) > 3
    assert all(t["maxDepth"] == 2 for t in SE.draw(5, 1, maxDepth=(2, 2)))


def test_summary_of_the_best_trials(spark):
    rows = [(i, score, 0.1, json.dumps({"depth": i, "mode": m})) for i, (score, m) in enumerate([(0.5, "x"), (0.9, "y"), (0.8, "y"), (0.9, "z"), (0.1, "w")])]
    trials = spark.createDataFrame(rows, "trial int, mean_test_score double, std_test_score double, params string")
    assert [r["trial"] for r in SE.ranked(trials, 3).orderBy("rank").collect()] == [1, 3, 2]
    got = {r["param"]: r for r in SE.parameter_summary(trials, 4).collect()}
    assert got["depth"]["mean"] == 1.5 and math.isclose(got["depth"]["std"], math.sqrt(1.25)) and got["depth"]["most_common"] is None
    assert got["mode"]["most_common"] == "y,x,z" and got["mode"]["mean"] is None and got["mode"]["n"] == 4
