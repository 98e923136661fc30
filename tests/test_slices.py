"""Large tables are stored slice by slice, and what a slice has shuffled is deleted before the next one."""

import random

from pyspark.sql import functions as F

from weft.model import WIDE_COLUMNS
from weft.operators import stored
from weft.operators.stored import RangeStore, StoredWide
from weft.plans import derived as D
from weft.session import FREE, Workspace, own_folder


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_slices_of_ties_and_nulls_hold_each_row_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "a", "b", "é", "\U0001f600"]), rng.choice([None, "x", "y"]), i) for i in range(700)] + [("same", "same", -1)] * 300
    df = spark.createDataFrame(rows, "a string, b string, i int")
    monkeypatch.setattr(stored, "SLICE_ROWS", 100)
    held = RangeStore.write(df, own_folder(spark, "slices"), ("a", "b"), 40)
    assert len(RangeStore._slices(df, ("a", "b"), 1000)) > 3
    got = [tuple(r) for p in held.parts for r in held.read_parts([p]).collect()]
    assert sorted(got, key=repr) == sorted(((*r, p) for *r, p in got), key=repr) and sorted((r[:3] for r in got), key=repr) == sorted(rows, key=repr)
    rank = lambda r: tuple((v is not None, (v or "").encode()) for v in r[:2])
    low = [rank(r) for r in held.lows]
    assert low == sorted(low) and all(low[held.parts.index(r[3])] <= rank(r) for r in got)
    # Rows of one place lie in one part where ranges are told by place alone.
    assert held.read().where(F.col("part") != held.place()).isEmpty()


def test_sliced_store_equals_whole_one(spark, sf, monkeypatch):
    whole = StoredWide.write(D.wide(spark, sf), own_folder(spark, "whole"), 700)
    monkeypatch.setattr(stored, "SLICE_ROWS", 1500)
    pieces = D.wide_pieces(spark, sf)
    assert len(pieces) > 2
    parts = StoredWide.write(pieces, own_folder(spark, "sliced"), 700)
    assert rows_of(parts.rows.read().drop("part")) == rows_of(whole.rows.read().drop("part"))
    assert rows_of(parts.coordinates.read().drop("part")) == rows_of(whole.coordinates.read().drop("part"))
    assert rows_of(parts.keys()) == rows_of(whole.keys()) and len(parts.keys([3]).inputFiles()) == 1
    assert parts.rows.read().where(F.col("part") != parts.rows.place()).isEmpty()
    assert parts.totals().agg(F.sum("n")).first()[0] == sum(whole.rows.counts)
    assert [tuple(r) for r in parts.nodes_list().collect()] == [tuple(r) for r in whole.nodes_list().collect()]


def test_shuffles_go_with_their_statement_and_read_tables_before_the_next(spark, sf, monkeypatch):
    """Before, all shuffle files and the unsorted table stayed to the end."""
    seen = []
    real, drop = Workspace.write_all, Workspace.drop
    monkeypatch.setattr(Workspace, "write_all", lambda self, frames, tag: seen.append((tag, spark.conf.get(FREE))) or real(self, frames, tag))
    monkeypatch.setattr(Workspace, "drop", lambda self, *frames: seen.append(("drop", len(frames))) or drop(self, *frames))
    StoredWide.write(D.wide(spark, sf), own_folder(spark, "freed"), 700)
    assert seen == [("keyed", "true"), ("drop", 1), ("coordinates", "true"), ("drop", 1)] and spark.conf.get(FREE) == "false"


def wide_rows(n, seed=0):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(f"L{i % 3}", f"r{i:04d}", pick("a", "f", "z", None), pick("t", None), pick(*"klmnopq"), "e", pick("I", "O"), pick("f", None), None, "x", None, None, None) for i in range(n)]


def test_merge_in_slices_copies_no_stored_table_and_empties_parts(spark, monkeypatch):
    """Before, a merge wrote all rows of the touched parts and all keys once more, twice for the keys."""
    columns = ", ".join(f"{c} string" for c in WIDE_COLUMNS)
    rows = wide_rows(400)
    held = StoredWide.write(spark.createDataFrame(rows, columns), own_folder(spark, "merge"), 40)
    monkeypatch.setattr(stored, "SLICE_ROWS", 90)
    copied = []
    real = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, tag: copied.append((tag, (out := real(self, df, tag)).count())) or out)
    # All rows of DTA_1 = "z" go to the front, so parts at the end are left empty; some keys are new.
    moved = [(*r[:2], None, *r[3:]) for r in rows if r[2] == "z"]
    added = [(f"L{i % 3}", f"new{i}", "zz", *rows[i][3:]) for i in range(5)]
    after = {(r[0], r[1], r[6]): r for r in rows} | {(r[0], r[1], r[6]): r for r in moved}
    for changes in (moved, moved, added):
        held.merge(spark.createDataFrame(changes, columns))
        after |= {(r[0], r[1], r[6]): r for r in changes}
        assert sorted(map(tuple, held.rows.read().select(*WIDE_COLUMNS).collect()), key=repr) == sorted(after.values(), key=repr)
        want = spark.createDataFrame(list(after.values()), columns)
        assert rows_of(held.keys().drop("bucket")) == rows_of(StoredWide._keys(want).drop("bucket"))
        assert rows_of(held.coordinates.read().drop("part")) == rows_of(StoredWide._firsts(want))
        assert sum(held.rows.counts) == len(after) == held.totals().agg(F.sum("n")).first()[0]
        if changes is moved:
            assert len(held.rows.filled()) < len(held.rows.parts)
    assert max(n for tag, n in copied if tag in ("changes", "rows", "keys", "all-keys")) <= len(moved) < 150


def test_null_keys_settle_nothing(spark):
    rows = [(0, "a", "b", None, 0), (0, "a", "b", None, 1), (0, "a", "b", "I", 0), (0, "a", "b", "I", 2), (1, "a", "b", "I", 0), (1, "a", "b", "I", 0)]
    df = spark.createDataFrame(rows, "part int, LNA_UID string, LIN_UID string, EDG_DIR string, _m int")
    assert rows_of(stored._settled(df, "part")) == sorted([(0, "a", "b", None)] * 2 + [(1, "a", "b", "I")] * 2, key=repr)
    plan = stored._settled(df.repartition(3, "part"), "part")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
