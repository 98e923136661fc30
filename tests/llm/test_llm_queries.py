"""The registered queries over whole small tables: against DuckDB where there is SQL, else against brute force."""

import duckdb
import pytest
from test_text_operators import brute_base, brute_repeats, key

from weft.llm import queries
from weft.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries.queries()[name](spark, sf)
    columns = ", ".join(sorted(found.columns))
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(con.sql(queries.oracle_sql()[name]).project(columns).fetchall())


def test_repeated_strings_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op1_repeated_strings(spark, sf).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_repeats(rows, 400, 200), key=key)


def test_licenses_query(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in queries.op2_licenses(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(rows[r["doc_id"]])


def test_chunks_query(spark, sf):
    docs = table(spark, sf, "documents")
    out = queries.op7_repeated_chunks(spark, sf).toPandas()
    assert len(out) == docs.count() and (out["n_removed"] <= out["n_bytes"]).all()
    exact = docs.groupBy("text").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "first").join(docs, "text").where("doc_id != first and octet_length(text) >= 200").toPandas()
    removed = out.set_index("doc_id")["n_removed"]
    size = out.set_index("doc_id")["n_bytes"]
    # A later copy of a text goes whole.
    assert len(exact) and all(removed[i] == size[i] for i in exact["doc_id"])


def test_chunks_query_equals_brute_force(spark, sf):
    """Chunks cut and copied chunks found again, from the texts alone."""
    from weft.llm import chunk_dedup as C

    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    seen, want = set(), {}
    for i, x in rows:
        runs, at = [], 0
        for e in C.cuts(x).tolist():
            if x[at:e] in seen:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = e
                else:
                    runs.append([at, e])
            seen.add(x[at:e])
            at = e
        runs = [r for r in runs if r[1] - r[0] >= C.SHORTEST]
        want[i] = (len(x), sum(b - a for a, b in runs), len(runs))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in queries.op7_repeated_chunks(spark, sf).collect()}
    assert got == want
