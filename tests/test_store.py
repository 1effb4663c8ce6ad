"""Commits of runs: all of one is seen, or nothing of it."""

import pytest

from quandrel.operators import calibrate
from quandrel.sources import store


def rows(spark, value, model=None):
    df = spark.createDataFrame([("a", float(value))], "item_id string, v double")
    return df if model is None else df.selectExpr("*", f"'{model}' AS model")


def test_a_failure_between_two_writes_leaves_the_old_run(spark, tmp_path):
    root = str(tmp_path)
    with store.writing(spark, root, "r") as run:
        run.save(rows(spark, 1, "raw"), "forecasts")
        run.save(rows(spark, 10), "params")
        run.save_config({"n": 1})
    with pytest.raises(RuntimeError):
        with store.writing(spark, root, "r") as run:
            run.save(rows(spark, 2, "raw"), "forecasts")
            raise RuntimeError
    with pytest.raises(Exception, match="broken"):
        with store.writing(spark, root, "r") as run:
            run.save(rows(spark, 3, "raw"), "forecasts")
            run.save(rows(spark, 30).selectExpr("item_id", "raise_error('broken') AS v"), "params")
    assert [r.v for r in store.load(spark, root, "forecasts").collect()] == [1.0]
    assert [r.v for r in store.params_of(spark, root, "r").collect()] == [10.0] and store.load_config(spark, root, "r") == {"n": 1}
    assert len(store.sweep(spark, root)) == 3 - 1 + 1 and store.sweep(spark, root) == []
    assert [r.v for r in store.load(spark, root, "forecasts").collect()] == [1.0]


def test_a_commit_replaces_what_it_writes_and_keeps_the_rest(spark, tmp_path):
    root = str(tmp_path)
    for run in ("r", "s"):
        with store.writing(spark, root, run) as one:
            one.save(rows(spark, 1, "raw").unionByName(rows(spark, 2, "eqc")), "forecasts")
            one.save(rows(spark, 3), "params")
    old = store.load(spark, root, "forecasts", "r")
    store.save(rows(spark, 9, "raw"), root, "forecasts", "r")
    assert sorted((r.run, r.model, r.v) for r in store.load(spark, root, "forecasts").collect()) == [("r", "raw", 9.0), ("s", "eqc", 2.0), ("s", "raw", 1.0)]
    assert sorted(r.v for r in old.collect()) == [1.0, 2.0]  # a reader keeps the version that it began with
    assert [r.v for r in store.params_of(spark, root, "r").collect()] == [3.0]
    assert store.state_of(spark, root, "r")[0] is None
    with pytest.raises(ValueError):
        store.load(spark, root, "metrics")
    with pytest.raises(ValueError):
        store.load(spark, root, "params", "nope")
    with pytest.raises(ValueError):
        store.save(rows(spark, 1), root, "drawings", "r")


def test_of_two_writers_of_one_number_the_later_fails(spark, tmp_path):
    root = str(tmp_path)
    one, two = store.Run(spark, root, "r"), store.Run(spark, root, "r")
    for k, run in enumerate((one, two)):
        run.save(rows(spark, k), "params")
    one.commit()
    with pytest.raises(FileExistsError):
        two.commit()
    assert [r.v for r in store.params_of(spark, root, "r").collect()] == [0.0]
    assert [n for n in store.Files(spark, root).names(f"{root}/manifests/r")] == ["000000000001.json"]


def test_a_stored_run_forecasts_without_a_fit(spark, tmp_path):
    from quandrel.operators import predictors
    from quandrel.sources import tables

    s, root = tables.lineitem_daily(spark, "/root/testdata/sf0.001"), str(tmp_path)
    model, post = predictors.RandomWalk(leads=(1,)), calibrate.EmpiricalOffset(warm_up=10)
    from quandrel.operators.forecast import align

    sigma = model.fit(s)
    offsets = post.fit(align(model.predict(s, sigma), s, tables.DAY))
    with store.writing(spark, root, "r") as run:
        run.save(sigma, "states")
        run.save(offsets, "params")
    states, params = store.state_of(spark, root, "r")
    key = lambda r: (r.item_id, r.timestamp, tuple(round(x, 6) for x in r.q) if r.q else ())
    want = sorted(key(r) for r in post.apply(model.predict(s, sigma), offsets).collect())
    assert sorted(key(r) for r in post.apply(model.predict(s, states), params).collect()) == want
