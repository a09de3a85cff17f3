import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.plans.graph import CycleError, Graph


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=60), st.integers(1, 6))
def test_order_and_execution(edges, threads):
    needs = {f"n{i:02}": set() for i in range(16)}
    for a, b in edges:
        if a != b:
            needs[f"n{max(a, b):02}"].add(f"n{min(a, b):02}")
    g = Graph(needs)
    order = g.order()
    assert sorted(order) == sorted(needs)
    assert all(order.index(u) < order.index(n) for n, us in needs.items() for u in us)
    seen = []
    g.execute(lambda n: seen.append(n), threads)
    assert sorted(seen) == sorted(needs)
    assert all(seen.index(u) < seen.index(n) for n, us in needs.items() for u in us)


def test_cycle_is_shown():
    with pytest.raises(CycleError, match="b -> c -> b"):
        Graph({"a": {"b"}, "b": {"c"}, "c": {"b"}}).order()


def test_first_error_stops():
    ran = []

    def run(n):
        if n == "b":
            raise RuntimeError("b failed")
        ran.append(n)

    with pytest.raises(RuntimeError, match="b failed"):
        Graph({"a": set(), "b": {"a"}, "c": {"b"}}).execute(run, 2)
    assert ran == ["a"]


def test_deep_chain():
    n = 3000
    g = Graph({f"m{i:05}": {f"m{i - 1:05}"} if i else set() for i in range(n)})
    assert g.order()[-1] == f"m{n - 1:05}"
