"""Range stores and the stored wide table: pages, pruned plans, change sets; equal to the plain procedures."""

import random

import pytest
from pyspark.sql import functions as F

from weft.model import WIDE_COLUMNS
from weft.operators import lookup, procs, stored
from weft.operators.stored import RangeStore, StoredWide
from weft.plans import derived as D
from weft.session import own_folder

HEADS = "LNA_UID string, RON_APP string, PCK_PGM_NME string, EXE_PGM_NME string, VRS_EXE_PGM string, APP_ENV string, DLY_PGM_TSP timestamp_ntz, LNA_TSP timestamp_ntz, PGM_TEC string, VRS_LNA_TOO string, TUS_IND int"


def made(n, seed=0):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (f"L{rng.randrange(3)}", f"r{i:05d}", pick("f1", "F2", "Fa", "g", None, "é", "hot", "hot"), pick("t1", "t2", None), pick("s", None), pick("e1", "E2"), pick("I", "O"), pick("f1", None), pick("t1", None), pick("s", None), pick("e1", None), None, None)
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(made(900), ", ".join(f"{c} string" for c in WIDE_COLUMNS))


@pytest.fixture(scope="module")
def heads(spark):
    return spark.createDataFrame([("L0", *(None,) * 10), ("L2", "a", *(None,) * 9)], HEADS)


def store_of(spark, wide, rows=60):
    return StoredWide.write(wide, own_folder(spark, "test"), rows)


@pytest.fixture(scope="module")
def store(spark, wide):
    return store_of(spark, wide)


def same(a, b):
    assert a.columns == b.columns and list(map(tuple, a.collect())) == list(map(tuple, b.collect()))


@pytest.mark.parametrize("given", [{}, {"column": "F"}, {"table": "t_", "env": "e"}, {"schema": "[^x]"}, {"column": " ", "max_rows": 3}, {"column": "nothing"}, {"column": "f", "max_rows": 1}])
def test_nodes_list(store, wide, given):
    same(store.nodes_list(**given), procs.nodes_list(wide, **given))


@pytest.mark.parametrize("use_edg", [False, True])
@pytest.mark.parametrize("kind", ["I", "O", "X", None])
def test_successors(store, wide, heads, kind, use_edg):
    for lin in ("r00007", "none"):
        key = wide.where(F.col("LIN_UID") == lin).select("LNA_UID", "LIN_UID", "EDG_DIR").first() or ("L0", lin, "I")
        same(store.successors_predecessors(heads, *key, kind, use_edg, 9), procs.successors_predecessors(wide, heads, *key, kind, use_edg, 9))


def test_stats(store, wide):
    same(store.stats().drop("RefreshedAt"), procs.stats(wide).drop("RefreshedAt"))


def test_lookups_read_few_files(spark, sf):
    """On the wide table of the order lines a resolved start reads under a tenth of the files, and pages only what they hold."""
    wide = D.wide(spark, sf)
    held = StoredWide.write(wide, own_folder(spark, "few"), 100)
    every = held.rows.read().inputFiles()
    assert len(every) > 40
    row = wide.where("EDG_DIR = 'O'").first()
    assert len(held.rows.read(*held.rows.span([row[c] for c in procs.DATA])).inputFiles()) < len(every) / 10
    page, total = held.coordinates.page(sum(held.coordinates.counts) - 150, 20)
    assert len(page.inputFiles()) <= 2 and page.count() == 20 and total == sum(held.coordinates.counts)
    assert len(held.keys([3]).inputFiles()) <= 1


def test_pages_equal_sorting(spark, store, wide):
    order = [F.asc_nulls_first(c) for c in stored.ROW_ORDER]
    plain = [tuple(r) for r in wide.select(*stored.ROW_ORDER).orderBy(*order).collect()]
    for where, left in ((None, plain), (F.col("DTA_1") == "hot", [r for r in plain if r[0] == "hot"])):
        for at in (0, 7, 130, len(left) - 3, len(left) + 5):
            page, total = store.rows.page(at, 11, where)
            assert total == len(left) and [tuple(r) for r in page.select(*stored.ROW_ORDER).collect()] == left[at : at + 11]


def check(spark, store, rows):
    """The store holds exactly ``rows``, in every order, and says so in its index."""
    wide = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in WIDE_COLUMNS))
    for s in (store, StoredWide(spark, store.root)):
        got = s.rows.read()
        assert sorted(map(tuple, got.select(*WIDE_COLUMNS).collect()), key=repr) == sorted(rows, key=repr)
        assert got.where(~F.col("DTA_2_k").eqNullSafe(F.substring("DTA_2", 1, 80))).isEmpty() and got.where(F.col("part") != s.rows.place()).isEmpty()
        firsts = s.coordinates.read().select(*procs.DATA, "LIN_UID", "LNA_UID", "EDG_DIR")
        want = StoredWide._firsts(wide).select(*firsts.columns)
        assert sorted(map(tuple, firsts.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert s.coordinates.read().where(F.col("part") != s.coordinates.place()).isEmpty()
        assert sorted(map(tuple, s.keys().drop("bucket").collect()), key=repr) == sorted(((r[0], r[1], r[6], *r[2:6], *r[7:11]) for r in rows), key=repr)
        same(s.stats().drop("RefreshedAt"), procs.stats(wide).drop("RefreshedAt"))
        assert s.totals().agg(F.sum("n")).first()[0] == len(rows)
        same(s.nodes_list(), procs.nodes_list(wide))


def test_change_sets(spark, wide):
    held = store_of(spark, wide)
    rows = {(r[0], r[1], r[6]): r for r in made(900)}
    rng = random.Random(4)
    before = set(held.rows.read().inputFiles())
    for turn in range(2):
        some = rng.sample(sorted(rows), 5)
        changes = [(*rows[k][:2], rng.choice(["f1", "zz", None]), *rows[k][3:]) for k in some] + [("L1", f"new{turn}{i}", *made(6, turn)[i][2:]) for i in range(6)]
        df = spark.createDataFrame(changes, ", ".join(f"{c} string" for c in WIDE_COLUMNS))
        rows |= {(r[0], r[1], r[6]): r for r in changes}
        first = held.merge(df)
        after = set(held.rows.read().inputFiles())
        if not turn:
            assert first["rows"] < len(held.rows.parts) and len(before & after) >= len(held.rows.parts) - first["rows"]
        check(spark, held, list(rows.values()))
    # A second run changes nothing.
    held.merge(df)
    check(spark, held, list(rows.values()))
    assert held.merge(df.limit(0)) == {"rows": 0, "coordinates": 0, "keys": 0}
    with pytest.raises(ValueError, match="once"):
        held.merge(df.unionByName(df))


def test_change_set_broken_off(spark, wide, monkeypatch):
    """A merge that fails between its writes is set right by running it again."""
    changes = spark.createDataFrame([("L0", "r00000", "zz", *made(1)[0][3:6], made(1)[0][6], *made(1)[0][7:])], ", ".join(f"{c} string" for c in WIDE_COLUMNS))
    key = made(1)[0]
    changes = changes.withColumn("LNA_UID", F.lit(key[0]))
    held = store_of(spark, wide)
    real, calls = RangeStore.replace, []

    def fails(self, *a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(self, *a)

    monkeypatch.setattr(RangeStore, "replace", fails)
    with pytest.raises(RuntimeError, match="lost"):
        held.merge(changes)
    monkeypatch.setattr(RangeStore, "replace", real)
    StoredWide(spark, held.root).merge(changes)
    rows = made(900)
    rows[0] = (key[0], "r00000", "zz", *key[3:])
    check(spark, StoredWide(spark, held.root), rows)


def test_empty_store(spark, wide, heads):
    held = store_of(spark, wide.limit(0))
    assert held.nodes_list().count() == 0 and held.successors_predecessors(heads, "a", "b", "I", "O").count() == 0
    held.merge(wide.limit(20))
    check(spark, held, made(20))


def test_node_pages(spark):
    edges = spark.createDataFrame([(f"n{i % 40}", f"m{i % 7}", f"t{i % 3}" if i % 5 else None) for i in range(80)], "src string, dst string, transformation string")
    held = lookup.stored_nodes(edges, own_folder(spark, "nodes"), 10)
    for args in ((1, 10), (4, 10), (9, 10), (2, 3, "M"), (1, 500, "[1-3]"), (1, 5, " ")):
        assert sorted(map(str, lookup.list_stored(held, *args).collect())) == sorted(map(str, lookup.list_nodes(edges, *args).collect()))
    assert len(held.page(30, 5)[0].inputFiles()) <= 2
