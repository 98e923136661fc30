
import numpy as np
import pytest

from weft.llm import embedding_dedup, posting_ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "x", 0.0) for i, v, l in rows], SCHEMA)


def near_table(seed=1, n=120, dim=12):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for c in range(6):
            centre = rng.normal(size=dim)
            for _ in range(n // 18):
                rows.append((i, (centre + rng.normal(size=dim) * rng.choice([0.02, 0.25, 0.4])).astype(np.float32), label))
                i += 1
    e = 10 * n
    rows += [(e + 1000 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(e + 2000, rows[5][1] * 3, rows[5][2]), (e + 2001, rows[5][1], 1 - rows[5][2])]
    rows += [(e + 3000, None, 0), (e + 3001, [], 0), (e + 3002, [0.0] * dim, 0), (e + 3003, [None] + [1.0] * (dim - 1), 0), (e + 3004, [float("nan")] * dim, 0), (e + 3005, [float("inf")] + [0.0] * (dim - 1), 1), (e + 3006, [1.0, 2.0], 0), (e + 3007, [2.0, 4.0], 0)]
    return rows + [(7, rows[9][1], rows[9][2])]


def usable(v, label):
    return v is not None and len(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_links(rows, cosine):
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            (_, x, la), (_, y, lb) = rows[a], rows[b]
            if usable(x, la) and usable(y, lb) and la == lb and len(x) == len(y):
                p, q = np.array(x, np.float64), np.array(y, np.float64)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], least[find(i)] == rows[i][0]) for i in range(n))


@pytest.mark.parametrize("block,part,tile,lengths", [(1024, 128, 8, 16), (16, 8, 2, 16), (4, 8, 3, 0)])
def test_grid_join(spark, monkeypatch, block, part, tile, lengths):
    # Blocks, tiles and stretches are cut by the driver's plan, parts by the tasks.
    placed, blocked = embedding_dedup._placed, embedding_dedup._blocked
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "STRETCH", 2 * tile)
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 3)
    monkeypatch.setattr(embedding_dedup, "_placed", lambda axes, eps: placed(axes if lengths else {}, eps))
    monkeypatch.setattr(embedding_dedup, "_blocked", in_worker(lambda axes: blocked(axes if lengths else {}), BLOCK=block, PART=part))
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = near_table()
    got = embedding_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 0.93)


def in_worker(made, **values):
    """``made`` whose function runs under other constants of the module."""

    def of(*args):
        inner = made(*args)

        def run(batches):
            from weft.llm import embedding_dedup

            for c, v in values.items():
                setattr(embedding_dedup, c, v)
            yield from inner(batches)

        return run

    return of


def test_join_tasks_copy_few_blocks(spark):
    """Vectors are copied for each tile, not for each pair of blocks."""
    n = 64
    blocks = spark.createDataFrame([(2, 1, 0, k, b"", b"", b"", b"", b"") for k in range(n)], "dim int, grp bigint, part int, k int, lo binary, hi binary, cls binary, copies binary, x binary")
    pairs = blocks.select("dim", "grp", "part", "k").crossJoin(blocks.selectExpr("part as part2", "k as k2")).where("k <= k2")
    copies = embedding_dedup._tasks(pairs, blocks).count()
    assert pairs.count() == n * (n + 1) // 2 and copies < pairs.count() / 3


def test_grid_join_of_nothing(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(table(spark, [(4, None, 1), (5, [1.0], None)])).collect()
    assert sorted(map(tuple, got)) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_boxes_never_exclude_links():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    ids, ones = np.arange(300), np.ones(300, np.int64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.8).sum(axis=1) - 1
    for cut in (0, 130):
        links = embedding_dedup.Links({8: axes}, 0.8)
        one, two = links.parts(ids[:cut], ones[:cut], x[:cut]), links.parts(ids[cut:], ones[cut:], x[cut:])
        links.join(two, None)
        if cut:
            links.join(one, None)
            links.join(one, two)
        assert [links.count.get(i, 0) for i in range(300)] == want.tolist()


def brute_nearest(rows, every, k):
    own = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and usable(v, 0) and len(v) == 12]
    out = {}
    for i, q in own:
        if i % every == 0:
            found = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in own if j != i)
            out[i] = found[:k]
    return out


def test_search_finds_neighbours(spark):
    rows = [(i, v, l) for i, v, l in near_table(5, 1800) if i != 7]
    got = posting_ann.search(table(spark, rows), every=50, k=10).collect()
    want = brute_nearest(rows, 50, 10)
    assert {r["query_id"] for r in got} == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in near})
        for _, v, s in mine:
            x = [np.array(y, np.float64) for j, y, _ in rows if j in (q, v)]
            assert s == pytest.approx(float(np.linalg.norm(x[0] - x[1])), abs=1e-12)
    assert hits / (10 * len(want)) >= 0.9


def test_search_ties_and_small_tables(spark):
    same = [(i, [1.0, 2.0], 0) for i in range(0, 60)]
    got = posting_ann.search(table(spark, same + [(None, [1.0, 2.0], 0), (70, [0.0, 0.0], 0)]), every=50, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert posting_ann.search(table(spark, [])).count() == 0
    few = posting_ann.search(table(spark, [(0, [1.0, 0.0], 0), (1, [3.0, 0.0], 0)])).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 2.0)]
    assert posting_ann.search(table(spark, [(0, [1.0, 0.0], 0)])).count() == 0


def test_graph_reaches_centroids():
    rng = np.random.default_rng(9)
    sample = rng.normal(size=(4000, 8))
    index = posting_ann.build(sample, 60_000, 10, 0.97)
    ids, _ = index.beam(sample[:200])
    d = posting_ann.distances(sample[:200], index.centroids)
    assert (ids[:, 0] == d.argmin(axis=1)).mean() > 0.9
    full = [set(np.flatnonzero(row <= index.ratio * row.min()).tolist()) for row in d]
    got = [set(index.select(q)) for q in sample[:200]]
    assert np.mean([len(g & f) / len(f) for g, f in zip(got, full)]) > 0.97 and all(g <= f for g, f in zip(got, full))


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(1000, 4))
    assert posting_ann.balanced(x, 7, np.random.default_rng(2)).shape == (7, 4)
