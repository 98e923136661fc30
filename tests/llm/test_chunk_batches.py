"""op7_repeated_chunks shuffles a chunk once for each batch of texts that holds it, and writes no table of all chunks."""

import random

import pytest
from test_text_operators import key, words

from weft.llm import chunk_dedup as C
from weft.llm.common import Workspace


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans) from the texts alone; null ids first, a row given twice counts once."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x, at, spans = (t or "").encode(), 0, []
        for e in C.cuts(x).tolist():
            if x[at:e] in seen:
                if spans and spans[-1][1] == at:
                    spans[-1][1] = e
                else:
                    spans.append([at, e])
            seen.add(x[at:e])
            at = e
        spans = [s for s in spans if s[1] - s[0] >= C.SHORTEST]
        out[i, t] = (i, len(x), sum(e - s for s, e in spans), len(spans))
    return sorted((out[r] for r in rows), key=key)


def test_rows_of_a_batch():
    rng = random.Random(21)
    a, b = words(rng, 300), words(rng, 300)
    texts = [b, a + " " + b, "", a]
    got = list(C._chunked(iter([{"d": [9, 2, 1, 5], "t": [90, 20, 10, 50], "text": texts}])))
    assert len(got) == 1 and all(len(v) == len(got[0]["d"]) for v in got[0].values())
    rows = [dict(zip(got[0], map(int, r))) for r in zip(*got[0].values())]
    first, runs = [r for r in rows if r["size"] > 0], [r for r in rows if r["size"] < 0]
    assert len({(r["high"], r["low"]) for r in first}) == len(first) and sum(r["size"] for r in first if r["d"] != 2) < 200
    # Each copied text is one run, but for what lies at the seam, and bears its own id in place of a digest.
    assert [(r["d"], r["high"], r["low"]) for r in runs] == [(5, 5, 50), (9, 9, 90)]
    assert all(-r["size"] > 0.8 * len(a) for r in runs)


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(C, "BATCH", 10)
    monkeypatch.setattr(C, "TEXTS", 3)
    texts = ["", "", "", "", "abcdefgh", "abcdefgh", "x"]
    got = list(C._gathered(iter([{"d": list(range(7, 0, -1)), "t": [0] * 7, "text": texts}])))
    assert [list(g) for g in got] == [[(5, 0), (6, 0), (7, 0)], [(2, 0), (3, 0), (4, 0)], [(1, 0)]]


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_batches_do_not_matter(spark, docs_of, parts):
    rng = random.Random(22)
    passage, line = words(rng, 70), words(rng, 40)
    rows = [(i, words(rng, 60) + (" " + passage if i % 3 == 0 else "") + " " + words(rng, 40) + (" " + line) * (i % 4)) for i in range(40)]
    rows += [(50 + i, rows[7 * i][1]) for i in range(4)] + [(-3, passage), (60, None), (61, ""), (None, line), (62, "ab")]
    rows += [rows[4], rows[3], (None, line)]
    got = C.removed_chunks(docs_of(rows).repartition(parts)).collect()
    assert sorted(map(tuple, got), key=key) == brute(rows)


def test_chunks_are_shuffled_once_and_not_stored(spark, docs_of, monkeypatch):
    seen = []
    written = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, tag: seen.append((tag, df._jdf.queryExecution().executedPlan().toString())) or written(self, df, tag))
    C.removed_chunks(docs_of([(1, "a b c"), (2, "d e f")]))
    assert [tag for tag, _ in seen] == ["spans"]
    assert seen[0][1].count("Exchange hashpartitioning(high") == 1 and seen[0][1].count("Exchange") == 2
