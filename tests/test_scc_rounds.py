"""Strongly connected components over any number of rounds."""

import inspect

import pytest

from codelode.operators import graph


def test_components_are_whole_or_an_error(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src int, dst int")
    assert sorted(tuple(r) for r in graph.scc(ring).collect()) == [(i, 0) for i in range(6)]
    with pytest.raises(RuntimeError):
        graph.scc(ring, 2)
    assert inspect.signature(graph.scc).parameters["most_rounds"].default is None
