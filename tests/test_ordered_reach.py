"""Numbers and neighbours in order, split text files, histories, topological numbers, reachability labels, probes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import condense, history, ordered, reach
from weft.sources import edges as sources
from weft.sources import text


def test_numbers_and_previous_rows(spark):
    rng = random.Random(0)
    keys = rng.sample(range(1000), 60)
    df = spark.createDataFrame([(k, rng.choice([None, f"v{k}"])) for k in keys], "k int, v string")
    rows = {r["k"]: r["v"] for r in df.collect()}
    for size in (7, 1000):
        got = {r["k"]: r["number"] for r in ordered.numbered(df, [F.col("k")], rows=size).collect()}
        assert got == {k: i for i, k in enumerate(sorted(keys))}
        got = {r["k"]: (r["v"], r["prev"]) for r in ordered.previous(df, [F.col("k")], "v", rows=size).collect()}
        want = sorted(keys)
        assert got == {k: (rows[k], rows[want[i - 1]] if i else None) for i, k in enumerate(want)}
    assert ordered.numbered(df.limit(0), [F.col("k")]).count() == 0 == ordered.previous(df.limit(0), [F.col("k")], "v").count()


def test_history_without_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 5)
    monkeypatch.setattr(ordered.previous, "__defaults__", ("prev", 5))
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice([None, "predecesseur"])) for i in range(40)]
    one = spark.createDataFrame(rows, "step int, id string, via string")
    many = one.withColumn("u", F.lit(1))
    assert sorted(map(tuple, history.graph(one).collect())) == sorted((r["src"], r["dst"]) for r in history.graph(many, ["u"]).collect())
    for cap in (3, 200):
        assert sorted(r["step"] for r in history.recorded(one, cap).collect()) == sorted(r["step"] for r in history.recorded(many, cap, ["u"]).collect())


def test_histories_loaded(spark):
    texts = spark.createDataFrame([(1, '["a", {"id": "b", "via": "x"}, {"via": "y"}, "c"]'), (2, "no json"), (3, None), (4, "[]"), (5, '["z"]')], "u int, text string")
    got = sorted(map(tuple, history.load_all(texts, ["u"]).collect()))
    assert got == [(1, 0, "a", None), (1, 1, "b", "x"), (1, 3, "c", None), (5, 0, "z", None)]
    for u, t in ((1, texts.first()["text"]), (4, "[]")):
        assert sorted(map(tuple, history.load(spark, t).collect())) == [r[1:] for r in got if r[0] == u]


def big_text(seed, breaks):
    rng = random.Random(seed)
    lines = ["# begin", "Noeuds"] + [f"node {i}" for i in range(40)] + ["aretes"]
    for i in range(400):
        lines.append(rng.choice([f"a{i % 30} b{i % 7} more", f"a{i % 3} b{i % 7}", "", "# rem", "  ", "NODES\nx y z" + str(i) + "\nEDGES", f"é{i} ç"]))
    return "".join(x + rng.choice(breaks) for x in lines)


@pytest.mark.parametrize("dedupe", [True, False])
@pytest.mark.parametrize("breaks", [["\n"], ["\r\n", "\n"], ["\n", "\x0b", "\r", "\x85"]])
def test_one_file_read_by_many_tasks(spark, tmp_path, dedupe, breaks):
    """Sections go on across splits; equal to the whole text, places and all."""
    if not dedupe and len(breaks) > 2:
        breaks = breaks[:1]
    whole = big_text(len(breaks), breaks)
    (tmp_path / "g.txt").write_bytes(whole.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = text.read_split(spark, str(tmp_path), dedupe)
        want = text.parse_text(spark, whole, dedupe)
        for a, b in zip(got, want):
            assert sorted(map(tuple, a.drop("file").collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bad", ["", "NOEUDS\n\nARETES\n", "A\nNOEUDS\nB\n", "ARETES\nA\n"])
def test_split_text_errors(spark, tmp_path, bad):
    (tmp_path / "good.txt").write_text("NOEUDS\nA\n")
    (tmp_path / "bad.txt").write_text(bad)
    with pytest.raises(text.GraphTextError):
        text.read_split(spark, str(tmp_path))


def dag(seed, n=40, m=70):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a < b})


def closure(rows, nodes):
    after = {}
    for a, b in rows:
        after.setdefault(a, set()).add(b)
    out = {}
    for v in sorted(nodes, reverse=True):
        out[v] = {v}.union(*(out[b] for b in after.get(v, ())))
    return out


@pytest.mark.parametrize("finish", [0, 1000])
def test_reachability_of_all_pairs(spark, finish):
    rows = dag(3)
    nodes = {x for r in rows for x in r} | {99}
    e = spark.createDataFrame(rows, "src int, dst int")
    known = reach.labels(e, spark.createDataFrame([(99,)], "id int"), finish)
    assert known.count() == len(nodes)
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes] + [(500, 1), (1, 1)], "a int, b int")
    want = closure(rows, nodes)
    assert {(r["a"], r["b"]): r["reaches"] for r in reach.answer(pairs, e, known).collect()} == {(a, b): b in want[a] for a in nodes for b in nodes}
    assert reach.settled_share(pairs, known) > 0.9


def test_topological_numbers(spark):
    rng = random.Random(5)
    g = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], "src int, dst int")
    scc = condense.strong_components(g)
    between = condense.condensed_edges(g, scc)
    for rows in (4, 1000):
        number = {r["scc"]: r["number"] for r in condense.topological_numbers(scc, between, rows=rows).collect()}
        assert sorted(number.values()) == list(range(scc.select("scc").distinct().count()))
        assert all(number[r["from_scc"]] < number[r["to_scc"]] for r in between.collect())


def test_probe_gives_up(spark):
    """A source that hangs gives false in time, and its job is cancelled."""

    def hangs():
        return spark.range(1).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long")

    began = time.time()
    assert not sources.can_connect(hangs, 1.5)
    assert time.time() - began < 4
    deadline = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert sources.can_connect(lambda: spark.range(3)) and not sources.can_connect(lambda: spark.range(0))

    def fails():
        raise OSError("no such host")

    assert not sources.can_connect(fails)
