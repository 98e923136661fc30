"""The suffix automaton against all windows, on odd rows, in blocks, and the cleaned texts."""

import random

import pytest

from weft.llm import suffix_automaton as S
from weft.llm.license_scan import words_of


def brute(docs, items, k=10):
    """(n_words, n_hit, items) of each document from all windows of all items."""
    windows = {}
    for i, t in items:
        w = words_of(t or "")
        for p in range(max(len(w) - k + 1, 1)):
            if w[p : p + k]:
                windows.setdefault(tuple(w[p : p + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words_of(t or ""), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def rows(df):
    from pyspark.sql import functions as F

    return sorted(map(tuple, df.select("doc_id", "n_words", S.hits().alias("n"), F.array_join("items", ",")).collect()), key=repr)


@pytest.fixture
def tables(spark, docs_of):
    rng = random.Random(3)
    say = lambda n, letters="abc": " ".join(rng.choices(letters, k=n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 40]) + 6)) for i in range(25)] + [(30, "B-b, c!"), (31, None), (32, ""), (33, "..."), (None, say(12)), (34, say(60)), (34, say(30)), (35, "z")]
    docs = [(i, say(rng.randrange(120)) + " Q, " + (rng.choice(items)[1] or "").upper() + " é " + say(20)) for i in range(60)]
    docs += [(90, None), (91, ""), (None, items[0][1]), (3, docs[3][1]), (3, docs[3][1]), (92, "x y Z"), (93, "w " * 400_000 + items[0][1])]
    return docs, items, docs_of(docs), spark.createDataFrame([(i, t, "en") for i, t in items], "item_id bigint, text string, spans string")


def test_scan_equals_all_windows(tables):
    docs, items, d, i = tables
    assert rows(S.scan(d, i)) == brute(docs, items)


def test_blocks_and_pieces_change_nothing(tables):
    docs, items, d, i = tables
    assert rows(S.scan(d, i, block_words=150, piece=15)) == brute(docs, items)
    assert rows(S.scan(d, i, window=4, block_words=200, piece=1)) == brute(docs, items, 4)


def test_longest_run():
    a = S.SuffixAutomaton(3)
    a.add("x", [b"a", b"b", b"c", b"d", b"e"])
    a.add("y", [b"q"])
    a.add("z", [b"b", b"c", b"d", b"x"])
    a.finish()
    # Spans that touch become one.
    assert a.find([b"b", b"c", b"d", b"x", b"c", b"d", b"e", b"o", b"q"]) == ([(0, 7, 4), (8, 9, 1)], {"x", "y", "z"})
    assert a.find([b"a", b"b", b"o"]) == ([], set()) and a.find([]) == ([], set())


def test_empty_tables(tables):
    docs, items, d, i = tables
    assert S.contaminated_words(d.limit(0), i).count() == 0
    assert rows(S.scan(d, i.limit(0))) == brute(docs, [])


def test_cleaned_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([
        (1, "Say: One two, three four FIVE six seven eight nine ten! " + "and more words follow here to keep it under the limit of cover", "s", 7),
        (2, item, "s", 8), (3, "nothing of it", "s", 9), (4, None, None, None), (5, "x" * 10 + " " + "A B C", "s", 1),
    ], "doc_id bigint, text string, items string, n_words bigint")
    items = spark.createDataFrame([(1, item), (2, "b c")], "item_id bigint, text string")
    out = S.decontaminate(docs, items)
    assert out.schema.names == docs.schema.names
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[5][1] == "x" * 10 + " A" and got[3] == (3, "nothing of it", "s", 9) and got[4] == (4, None, None, None)
    assert got[1][1] == "Say: ! and more words follow here to keep it under the limit of cover"
    kept = {r["doc_id"]: r["text"] for r in S.decontaminate(docs, items, max_coverage=1.0).collect()}
    assert kept[2] == ""
    assert kept[5] == "x" * 10 + " A"
    # Runs shorter than ``longest`` stay; short items go all the same.
    long = {r["doc_id"]: r["text"] for r in S.decontaminate(docs, items, longest=11, max_coverage=1.0).collect()}
    assert long[1].startswith("Say: One two") and long[2] == "" and long[5] == "x" * 10 + " A"
