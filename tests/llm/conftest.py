import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        if extra:
            return spark.createDataFrame([(i, t, "en", "s", 0, 1.5, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out string")
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
