"""Loops and labels of stated orders against the plain closure."""

import random

import pytest

from fableguard.operators import partial_order
from fableguard.plans.facts import Facts


def closed(edges):
    known = set(edges)
    while new := {(s, a, d) for s, a, b in known for r, c, d in known if s == r and b == c} - known:
        known |= new
    return known


def graphs():
    """Chains, loops of chains, loops of one, forests, dense and random graphs, two stories with the same points."""
    rng = random.Random(8)
    chain = lambda s, *ps: [(s, a, b) for a, b in zip(ps, ps[1:], strict=False)]
    edges = chain("chain", *range(20)) + chain("loop", 1, 2, 3, 4, 1) + [("loop", 4, 9), ("loop", 9, 10), ("loop", 10, 11), ("self", 5, 5), ("self", 5, 6)]
    edges += chain("fork", 1, 2, 3, 9) + chain("fork", 1, 4, 5, 6, 9) + chain("fork", 9, 10, 11, 12) + chain("fork", 7, 8, 10)
    edges += chain("two", 1, 2, 3, 1) + chain("two", 3, 4, 5) + chain("two", 5, 6, 7, 5) + [("two", 7, 7)] + chain("chain2", 3, 2, 1)
    edges += chain("between", 1, 2, 1) + chain("between", 2, 3, 4, 6) + chain("between", 3, 5, 6, 7, 8, 7) + chain("circle", 4, 2, 9, 4)
    for s in range(4):
        edges += [(f"r{s}", rng.randrange(14), rng.randrange(14)) for _ in range(8 + 5 * s)]
    return [*edges, edges[0]]


@pytest.fixture(scope="module")
def order(spark):
    return partial_order.Order.of(spark.createDataFrame([*graphs(), ("chain", None, 3)], "story_id string, t1 long, t2 long"))


def test_circular(spark):
    got = {tuple(r) for r in partial_order.circular(spark.createDataFrame(graphs(), "story_id string, t1 long, t2 long")).collect()}
    known = closed(graphs())
    assert got == {(s, a, b) for s, a, b in known if (s, b, a) in known}


def test_before_is_the_closure(spark, order):
    points = {(s, p) for s, *ends in graphs() for p in ends}
    pairs = [(s, a, b) for s, a in points for r, b in points if s == r]
    got = order.before(spark.createDataFrame([*pairs, ("chain", 99, 1)], "story_id string, x long, y long"), "x", "y")
    assert {tuple(r) for r in got.collect()} == closed(graphs())


def test_runs_have_no_pairs(order):
    """A chain of 20 points has two hubs, so one pair of them."""
    assert order.hubs.where("story_id = 'chain'").count() == 1


def test_no_order(spark):
    empty = spark.createDataFrame([], "story_id string, t1 long, t2 long")
    assert partial_order.circular(empty).collect() == []
    nothing = partial_order.Order.of(empty)
    assert nothing.before(spark.createDataFrame([("s", 1, 2)], "story_id string, x long, y long"), "x", "y").collect() == []


def test_rules_over_a_stated_order(spark, order):
    ev = [("fork", 1, "die", 4, 5), ("fork", 2, "walk", 9, 9), ("fork", 3, "walk", 2, 3), ("fork", 4, "walk", 8, 8), ("loop", 5, "die", 2, 2), ("loop", 6, "walk", 1, 1)]
    events = spark.createDataFrame([(s, i, k, None, a, b, None, None, False) for s, i, k, a, b in ev], "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    facts = Facts(spark, events, spark.createDataFrame([(s, i, "agent", "ann") for s, i, *_ in ev], "story_id string, event_id long, role string, arg string"))
    assert {tuple(r) for r in partial_order.dead_agent(facts, order).collect()} == {("fork", 2, "ann"), ("loop", 5, "ann"), ("loop", 6, "ann")}
    known = closed(graphs())
    want = {(s, i, j) for s, i, _, _, x in ev for r, j, _, y, _ in ev if s == r and (s, x, y) in known}
    assert {tuple(r) for r in partial_order.precedes(facts, order).collect()} == want
