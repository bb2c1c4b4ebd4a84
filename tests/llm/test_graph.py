import numpy as np
import pytest

from rowquarry.llm import graph
from rowquarry.llm.graph import components, forest


def brute(a, b):
    root = {x: x for x in [*a, *b]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def cases():
    rng = np.random.default_rng(3)
    yield [], []
    yield [5, 5, 7], [5, 5, 8]
    yield list(range(1, 60)), list(range(60 - 60, 59))  # a path
    yield [0] * 200, list(range(1, 201))  # a star
    yield rng.integers(0, 400, 300).tolist(), rng.integers(0, 400, 300).tolist()
    yield rng.integers(-50, 50, 40).tolist(), rng.integers(-50, 50, 40).tolist()


@pytest.mark.parametrize("block", [1_000_000, 7])
@pytest.mark.parametrize("k", range(6))
def test_components(spark, monkeypatch, k, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    a, b = list(cases())[k]
    got = components(spark.createDataFrame(list(zip(a, b, strict=True)), "a long, b long").repartition(3)).collect()
    want = brute(a, b)
    assert {r.node: r.component for r in got} | {x: x for x in want if want[x] == x} == want
    assert len({r.node for r in got}) == len(got)


def test_forest():
    a, b = (np.array(x, np.int64) for x in list(cases())[4])
    child, root = forest(a, b)
    want = brute(a.tolist(), b.tolist())
    assert dict(zip(child.tolist(), root.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}
