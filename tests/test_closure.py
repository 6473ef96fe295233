"""Walks, levels, exact order and retraction against plain Python on random and deep graphs."""

import random

import pytest

from tallyweave.model import ReconcileError
from tallyweave.operators import closure


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "from_guid string, to_guid string, pos int")


def nodes(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "guid string, ord int")


def plain_walk(seeds, pairs):
    out = {}
    level, queue = 0, list(dict.fromkeys(seeds))
    by = {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    while queue:
        for g in queue:
            out[g] = (level, len(out))
        level, queue = level + 1, list(dict.fromkeys(b for g in queue for b in by.get(g, ()) if b not in out))
    return out


@pytest.fixture(params=[512, 3], ids=["small levels", "wide levels"])
def literals(request, monkeypatch):
    monkeypatch.setattr(closure, "LITERALS", request.param)
    monkeypatch.setattr(closure.Runs, "HELD", 20)
    monkeypatch.setattr(closure.Runs, "EIGHT", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_plain_walk(spark, literals, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 60)}") for _ in range(70)]
    seeds = [f"n{rng.randint(0, 60)}" for _ in range(4)]
    got = {r.guid: (r.level, r["rank"]) for r in closure.walk(nodes(spark, seeds), edges(spark, pairs)).collect()}
    assert got == plain_walk(seeds, pairs)
    free = closure.walk(nodes(spark, seeds), edges(spark, pairs), ranked=False).collect()
    assert {r.guid: r.level for r in free} == {g: level for g, (level, _) in got.items()} and {r["rank"] for r in free} == {None}


def test_walk_down_a_long_chain(spark):
    n = 120
    got = closure.walk(nodes(spark, ["n0"]), edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(n)])).collect()
    assert sorted((r.level, r["rank"], r.guid) for r in got) == [(i, i, f"n{i}") for i in range(n + 1)]


def test_walk_of_nothing_and_of_nulls(spark):
    assert closure.walk(nodes(spark, []), edges(spark, [("a", "b")])).count() == 0
    got = closure.walk(nodes(spark, ["a", None]), edges(spark, [("a", None), (None, "b"), ("a", "c")])).collect()
    assert {r.guid for r in got} == {"a", "c"}


def levels_of(names, pairs):
    need = {n: {b for a, b in pairs if a == n and b in names} for n in names}
    out = {}
    while True:
        ready = [n for n in names if n not in out and need[n] <= out.keys()]
        if not ready:
            return {n: out.get(n) for n in names}
        out |= {n: max((out[b] + 1 for b in need[n]), default=0) for n in ready}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_equal_plain_levels(spark, literals, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    pairs = [tuple(f"n{x}" for x in sorted(rng.sample(range(45), 2))) for _ in range(70)] + [("n20", "n20"), ("n39", "n38")]
    got = {r.guid: r.level for r in closure.dependency_levels(nodes(spark, names), edges(spark, pairs)).collect()}
    assert got == levels_of(names, pairs)
    with pytest.raises(ReconcileError):
        closure.dependency_levels(nodes(spark, names), edges(spark, pairs), most=1)


@pytest.mark.parametrize(("seed", "most"), [(1, 1_000_000), (2, 4), (3, 0)])
def test_places_equal_the_exact_order(spark, literals, seed, most):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    hubs = [("n%d" % i, "n%d" % rng.choice([37, 38, 39])) for i in range(30)]  # many pieces of one top
    pairs = hubs + [tuple(f"n{x}" for x in sorted(rng.sample(range(40), 2))) for _ in range(40)] + [("n5", "out")]
    pairs += [("n9", "n8"), ("n8", "n9")] if seed == 1 else []
    ranked = [(n, rng.randint(0, 30)) for n in names]
    want = closure.dependency_order(ranked, pairs)
    got = closure.dependency_places(spark.createDataFrame(ranked, "guid string, rank int"), edges(spark, pairs), most).collect()
    assert [r.guid for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(40))


def test_retraction_goes_on_until_nothing_falls(spark, literals):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(30)]  # n30 is nowhere
    ring = [("a", "b"), ("b", "c"), ("c", "a")]  # needs itself only
    lost = [("x", "y"), ("y", "x"), ("y", "nowhere"), ("w", "there"), ("w", "a"), ("v", "n3"), ("v", "nowhere")]
    planned = [*(f"n{i}" for i in range(30)), *"abcxywv"]
    refs = edges(spark, [*chain, *ring, *lost, ("not planned", "nowhere")])
    got = closure.retracted(refs, nodes(spark, ["there", "y2"]), nodes(spark, planned)).collect()
    want = {f"n{i}": f"n{i + 1}" for i in range(30)} | {"x": "y", "y": "nowhere, x", "v": "n3, nowhere"}
    assert {r.source_guid: r.detail for r in got} == want
    assert {(r.verb, r.reason) for r in got} == {("SKIP", "dependency_unresolved")}
    assert closure.retracted(edges(spark, ring), nodes(spark, []), nodes(spark, ["a", "b", "c"])).count() == 0
