"""Ranked search against scores of all documents, byte codes, heaps, and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from weft.llm import ranked_search as R
from weft.llm.license_scan import words_of


def brute(docs, items, k=10):
    tf = [(i, Counter(words_of(t or ""))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words_of(t or ""))
    out = []
    for item, words in terms.items():
        scored = []
        for i, c in tf:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def tables(spark, docs_of):
    rng = random.Random(5)
    say = lambda n: " ".join(f"W{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n))
    docs = [(i, say(rng.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(400, None), (401, ""), (402, " .,; "), (None, docs[7][1]), (5, docs[7][1]), (403, "é é w1-w1 É"), (404, "w2 " * 300_000)]
    items = [(i, say(25)) for i in range(20)] + [(50, docs[7][1]), (51, None), (52, "..."), (53, "nowhere found"), (None, say(9)), (54, say(4)), (54, say(4)), (55, "é"), (3, say(5))]
    return docs, items, docs_of(docs, extra=True), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")


def test_search_equals_all_scores(tables):
    docs, items, d, i = tables
    want = brute(docs, items)
    assert rows(R.ranked(d, i)) == want
    # Small shards and blocks: tops of many shards meet.
    assert rows(R.search(R.build_index(d.repartition(3), 4000), i, block_terms=40)) == want
    assert rows(R.ranked(d, i, 1)) == brute(docs, items, 1)


def test_fewer_documents_than_results(spark, docs_of):
    docs, items = [(1, "a b"), (2, "a a c"), (3, "d")], [(1, "A c"), (2, "x")]
    i = spark.createDataFrame(items, "item_id int, text string")
    got = R.ranked(docs_of(docs), i)
    assert rows(got) == brute(docs, items) and dict(got.dtypes)["item_id"] == "int"
    assert R.ranked(docs_of([]), i).count() == 0 and R.ranked(docs_of(docs), i.limit(0)).count() == 0
    assert R.ranked(docs_of([(1, None)]), i).count() == 0


def test_index_holds_every_term(tables, spark):
    docs, _, d, _ = tables
    index = R.build_index(d, 3000).collect()
    assert len({r["shard"] for r in index}) > 3
    df = Counter(w.decode() for _, t in docs for w in set(words_of(t or "")))
    found = Counter()
    ids = {r["shard"]: r["ids"] for r in index if r["term"] is None}
    for r in index:
        if r["term"] is not None:
            number = np.cumsum(R.unpacked(r["numbers"]))
            assert r["df"] == len(number) == len(R.unpacked(r["counts"])) and number[-1] < len(ids[r["shard"]])
            found[r["term"]] += r["df"]
    assert found == df


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        for top in (1, 100, 1 << 14, 1 << 40):
            v = rng.integers(0, top, n)
            data, size = R.packed(v)
            assert size.sum() == len(data) and (n == 0 or (R.unpacked(data.tobytes()) == v).all())


def test_heaps_equal_sorting():
    """Few distinct scores, so ties abound."""
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randrange(1, 60), rng.randrange(1, 8)
        lists, scores = [], Counter()
        for _ in range(rng.randrange(1, 9)):
            held = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            gain, w = np.array([rng.randrange(1, 4) for _ in held]), rng.randrange(4)
            lists.append((w, memoryview(np.array(held)), memoryview(gain), int(gain.max())))
            for d, g in zip(held, gain.tolist()):
                scores[d] += w * g
        want = sorted(((s, -d) for d, s in scores.items() if s > 0), reverse=True)[:k]
        assert sorted(R.best(lists, k), reverse=True) == want
