import random

import pytest

from graphloom.operators import cycles
from graphloom.operators.cycles import strong_components


def brute(pairs):
    nodes = {x for p in pairs for x in p}
    after = {x: {b for a, b in pairs if a == x} for x in nodes}

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    reached = {x: reach(x) for x in nodes}
    alike = {x: [y for y in reached[x] if x in reached[y]] for x in nodes}
    return {x: min(s) for x, s in alike.items() if len(s) > 1}


def result(df):
    rows = df.collect()
    out = {r["node"]: r["component"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 60
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range((50, 75, 110)[seed])]
    assert result(strong_components(spark.createDataFrame(pairs * 2, "src int, dst int"))) == brute(pairs)


def test_names_and_no_edges(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"), ("d", "f")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert result(strong_components(e)) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert result(strong_components(e.where("false"))) == {} and result(strong_components(e.where("src = 'e'"))) == {}


def test_rounds_grow_with_the_logarithm(spark):
    n = 1000
    rounds = []
    ring = spark.createDataFrame([(i, (i - 1) % n) for i in range(n)], "src int, dst int")
    assert set(result(strong_components(ring, rounds)).items()) == {(i, 0) for i in range(n)}
    assert len(rounds) < 20, len(rounds)


def test_a_chain_of_rings(spark):
    pairs = [(10 * k + i, 10 * k + (i + 1) % 5) for k in range(8) for i in range(5)] + [(10 * k + 2, 10 * k + 13) for k in range(7)] + [(i, i + 1) for i in range(500, 540)]
    rounds = []
    assert result(strong_components(spark.createDataFrame(pairs, "src int, dst int"), rounds)) == brute(pairs)
    assert len(rounds) < 60, len(rounds)


@pytest.mark.parametrize("seed", range(2))
def test_many_arcs_a_node_take_few_rounds_over_few_arcs(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    groups = [range(30 * k, 30 * k + 30) for k in range(4)]  # the last two point on only
    pairs = [(a, b) for g in groups for a in g for b in rnd.sample(list(g), 15) if a != b and (g.start < 60 or a < b)] + [(5, 35), (40, 61), (65, 95)]
    seen, ends = [], cycles._ends

    def counted(arcs, rounds):
        seen.append(arcs.count())
        return ends(arcs, rounds)

    monkeypatch.setattr(cycles, "_ends", counted)
    assert result(strong_components(spark.createDataFrame(pairs, "src int, dst int"))) == brute(pairs)
    assert max(seen) <= 4 * 120 < len(set(pairs)) / 2, seen


def test_what_no_cycle_holds_takes_no_turn(spark, monkeypatch):
    rnd = random.Random(1)
    pairs = [(a, a + rnd.randrange(1, 150)) for a in range(300) for _ in range(2)] + [(7, 3), (3, 7)]
    seen, ends = [], cycles._ends
    monkeypatch.setattr(cycles, "_ends", lambda arcs, rounds: seen.append(arcs.count()) or ends(arcs, rounds))
    assert result(strong_components(spark.createDataFrame(pairs, "src int, dst int"))) == brute(pairs)
    assert max(seen) < len(set(pairs)) / 2, seen
