"""Long chains and rings: rounds follow the logarithm of their length, with all bounds at 0."""

import random
import time

import pytest

from weft.operators import condense


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs) or [(1, 1)], "src bigint, dst bigint").limit(len(pairs))


def ring(ids):
    return list(zip(ids, ids[1:] + ids[:1]))


def test_rings_and_their_tails(spark):
    a, b = list(range(300)), list(range(1000, 1130))
    tail = list(zip([7, *range(2000, 2050)], range(2000, 2051)))
    pairs = ring(a) + ring(b) + tail
    start = time.perf_counter()
    found = {r["id"]: r["scc"] for r in condense.strong_components(frame(spark, ring(a) + ring(b)), driver_edges=0, finish=0).collect()}
    assert found == {x: 0 for x in a} | {x: 1000 for x in b}
    assert time.perf_counter() - start < 60
    found = {r["id"]: r["scc"] for r in condense.strong_components(frame(spark, pairs), driver_edges=0, finish=0).collect()}
    assert found == {x: 0 for x in a} | {x: 1000 for x in b} | {x: x for x in range(2000, 2051)}
    start = time.perf_counter()
    found = {r["id"]: r["scc"] for r in condense.strong_components(frame(spark, pairs), driver_edges=0).collect()}
    assert found[299] == 0 and found[2050] == 2050
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_with_chains(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 10])
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(n + 2)}
    new = 100
    for a, b in list(pairs)[: n // 2]:
        k = rng.randint(1, 6)
        pairs.discard((a, b))
        ids = [a, *rng.sample(range(new, new + 50), k), b]
        pairs |= set(zip(ids, ids[1:]))
        new += 50
    pairs = sorted(pairs)
    e = frame(spark, pairs)
    want = condense.tarjan(pairs)
    for finish in (0, condense.FINISH):
        assert {r["id"]: r["scc"] for r in condense.strong_components(e, driver_edges=0, finish=finish).collect()} == want
        cyclic = len(set(want.values())) < len(want) or any(a == b for a, b in pairs)
        assert condense.has_cycle(e, finish) == cyclic
        up = [(a, b) for a, b in pairs if a < b]
        layer = {x: 0 for p in up for x in p}
        for _ in layer:
            for a, b in up:
                layer[b] = max(layer[b], layer[a] + 1)
        assert {r["id"]: r["layer"] for r in condense.topological_layers(frame(spark, up), finish=finish).collect()} == layer
        if cyclic:
            with pytest.raises(ValueError):
                condense.topological_layers(e, finish=finish)


def test_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(400)]
    e = frame(spark, pairs)
    assert not condense.has_cycle(e, 0) and condense.has_cycle(frame(spark, pairs + [(400, 399)]), 0) and condense.has_cycle(frame(spark, ring(list(range(50)))), 0)
    assert {r["id"]: r["layer"] for r in condense.topological_layers(e, finish=0).collect()} == {i: i for i in range(401)}
    with pytest.raises(ValueError):
        condense.topological_layers(frame(spark, ring(list(range(9)))), finish=0)


def test_components_raise_instead_of_gathering(spark, monkeypatch):
    from weft.operators import components

    monkeypatch.setattr(components, "ROUNDS", 0)
    with pytest.raises(RuntimeError):
        components.components(frame(spark, [(1, 2), (3, 4)]), finish=1)


def test_shared_folder_off_local(spark, monkeypatch):
    from weft import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_clean_deletes_the_tables_of_this_application(spark):
    from weft.session import Workspace, clean

    kept = Workspace(spark, "x").write(spark.range(3).toDF("id"), "t")
    assert kept.count() == 3
    clean(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        spark.read.parquet(kept._weft_path).count()
