"""Sequential search against a grid of as many trials, and after a stop."""

import itertools
import math

import pytest

from basketry.operators import experiments

SPACE = {"x": ("uniform", -2.0, 2.0), "rate": ("log", 1e-4, 1.0), "layers": ("int", 1, 9), "kind": ("choice", ["a", "b", "c"])}


def surface(p):
    return -((p["x"] - 0.7) ** 2) - (math.log10(p["rate"]) + 2.3) ** 2 - 0.1 * (p["layers"] - 6) ** 2 - 0.5 * (p["kind"] != "b")


def test_better_than_a_grid(spark, tmp_path):
    """By the median of nine seeds, against a grid that passes near the best point."""
    found = []
    for seed in range(9):
        study, done = experiments.Study(spark, f"file://{tmp_path}/s", SPACE, seed), []
        for number in range(54):
            params = study.propose(done)
            done.append({"trial": number, "params": params, "value": surface(params)})
        found.append(max(t["value"] for t in done))
    grid = [dict(zip(SPACE, v)) for v in itertools.product([-1.0, 0.0, 1.0], [1e-3, 1e-2, 1e-1], [3, 7], "abc")]
    assert len(grid) == 54 and sorted(found)[4] > max(map(surface, grid))


def test_goes_on_after_a_stop(spark, tmp_path):
    whole = experiments.Study(spark, f"file://{tmp_path}/whole", SPACE)
    whole.run(surface, 16)
    place, calls = f"file://{tmp_path}/broken", []

    def dies(p):
        calls.append(p)
        if len(calls) == 13:
            raise KeyboardInterrupt
        return surface(p)

    with pytest.raises(KeyboardInterrupt):
        experiments.Study(spark, place, SPACE).run(dies, 16)
    (tmp_path / "broken" / "_draft-left").mkdir()
    experiments.Study(spark, place, SPACE).run(surface, 16)
    assert experiments.Study(spark, place, SPACE).trials() == whole.trials()
    assert experiments.Study(spark, place, SPACE).run(lambda p: pytest.fail("all are done"), 16) == max(whole.trials(), key=lambda t: t["value"])


def test_no_number_is_the_worst(spark, tmp_path):
    study = experiments.Study(spark, f"file://{tmp_path}/s", {"x": ("int", 1, 1)})
    assert study.trials() == []
    values = iter([math.nan, -5.0])
    assert study.run(lambda p: next(values), 2)["value"] == -5.0 and experiments.experiment_folder("/a/", 1, [2], 3, "relu", 0.1, "n") == "/a/e1_l2_ep3_rel_lr0.1_n"
