"""The wide table is dealt by order once, and its derived keys are added behind the shuffle of its store."""

from pyspark.sql import functions as F

from weft.model import WIDE_COLUMNS
from weft.operators.stored import RangeStore, StoredWide
from weft.plans import derived
from weft.session import own_folder


def test_one_deal_by_order(spark):
    plan = derived.wide(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_returnflag" not in plan


def test_derived_keys_are_not_shuffled(spark, monkeypatch):
    seen = []
    written = RangeStore.write.__func__
    monkeypatch.setattr(RangeStore, "write", classmethod(lambda cls, df, *a: seen.append(df.columns) or written(cls, df, *a)))
    wide = derived.wide(spark, "/root/testdata/sf0.001").limit(500)
    store = StoredWide.write(wide, own_folder(spark, "narrow"), 100)
    assert seen[0] == list(WIDE_COLUMNS)
    assert store.rows.read().where(F.col("DTA_2_k").eqNullSafe(F.substring("DTA_2", 1, 80))).count() == 500
