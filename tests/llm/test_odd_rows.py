"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names for operators and pipeline stages."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from weft.llm import chunk_dedup, license_scan, mixing, suffix_dedup, superminhash

SF = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASH = ("_size", "_id", "_k", "_d", "t", "row", "group", "score", "label", "component_id", "_rank", "copies")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, *(f"{c}{n}" for c in CLASH)) for n, (i, t, s) in enumerate(rows)], SCHEMA)


PLAIN = [(i, words(i, 60), f"s{i % 2}") for i in range(8)]
ODD = PLAIN + [(20, None, "s0"), (21, "", "s1"), (22, words(22, 30), None), (None, words(23, 30), "s0"), (3, words(3, 60), "s1"), (24, words(4, 60), "s1"), (None, None, None)]


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows(spark, stage):
    docs = clashing(spark, ODD)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    given = Counter(map(tuple, docs.collect()))
    if stage == 4:
        got = out.collect()
        assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _, _ in ODD)
        return
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    if stage == 0:
        assert got <= given
    elif stage == 1:
        assert got <= given and sum(given.values()) - sum(got.values()) == 2
    elif stage == 2:
        left = {r[5:]: r for r in got}
        assert len(got) == len(given) and all(left[r[5:]][0] == r[0] for r in given)
        # The row that repeats an id with its text is the same document; the copy under another id is not.
        assert [left[r[5:]][1] for r in given if r[0] == 3] == [PLAIN[3][1]] * 2
        assert [left[r[5:]][1] for r in given if r[0] == 24] == [""]
    else:
        assert set(got) <= set(given) and max(got.values()) <= 2


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_an_empty_table(spark, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, clashing(spark, ODD).limit(0), SF).count() == 0


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    assert chunk_dedup.removed_chunks(none).count() == 0 and license_scan.scan(none).count() == 0 and mixing.mix(none).count() == 0


def test_very_long_texts(spark, docs_of):
    """Texts beyond the pieces of 1 MiB: a passage lies across the border, another far behind it."""
    passage, late = words(1, 90), words(2, 90)
    long = words(3, 150_000)[: (1 << 20) - 200] + " " + passage + " " + words(4, 60_000) + " MIT licence " + late + " mit  License"
    assert len(long) > (1 << 20) + 300_000
    rows = [(1, long), (2, words(5, 50) + " " + passage), (3, late), (4, words(6, 50)), (5, long)]
    docs = docs_of(rows[:4])
    got = {r["doc_id"]: r for r in suffix_dedup.removed_bytes(docs).collect()}
    assert got[3]["n_removed"] == len(late) and got[4]["n_removed"] == 0
    # A blank stands before both passages, and one more after the late one.
    assert got[2]["n_removed"] == len(passage) + 1 and got[1]["n_removed"] == len(passage) + 1 + len(late) and got[1]["n_spans"] == 2
    cut = {r["doc_id"]: r for r in chunk_dedup.removed_chunks(docs).collect()}
    assert cut[1]["n_removed"] == cut[4]["n_removed"] == 0 and cut[2]["n_removed"] > 0.7 * len(passage) and cut[3]["n_removed"] > 0.7 * len(late)
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    n = len(long.split())
    assert found[1]["n_words"] == n and found[1]["first_word"] == found[1]["last_word"] == n - 2 and "mit" in found[1]["labels"]
    near = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs_of(rows)).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
