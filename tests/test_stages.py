"""Tables between steps: what a step leaves, and when."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from loglattice.plans.stages import materialise, shared_dir, step


def tables(spark) -> set[str]:
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_a_step_leaves_what_it_keeps(spark):
    before = tables(spark)
    with step(spark):
        parts = materialise(spark.range(100))
        with step(spark):
            inner = materialise(materialise(parts.selectExpr("id % 7 AS k")).distinct(), keep=True)
            assert len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 2
        found = materialise(inner.where("k > 1"), keep=True)
    assert len(tables(spark) - before) == 1
    assert sorted(r.k for r in found.collect()) == [2, 3, 4, 5, 6]


def test_a_step_that_fails_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(ValueError, match="half-way"), step(spark):
        materialise(spark.range(10))
        raise ValueError("half-way")
    assert tables(spark) == before


def test_steps_of_threads_are_apart(spark):
    before = tables(spark)
    with step(spark), ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: materialise(spark.range(5))).result()
    assert len(tables(spark) - before) == 1 and other.count() == 5
