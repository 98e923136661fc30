"""The queries of this subpackage: one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import chunk_dedup, embedding_dedup, license_scan, mixing, name_join, nbsvm, packing, posting_ann, ranked_search, suffix_automaton, suffix_dedup, superminhash, toxicity
from weft.llm.common import table


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.removed_chunks(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.search(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_join.join(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeated_strings": op1_repeated_strings,
        "op2_licenses": op2_licenses,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_mixing": op5_mixing,
        "op6_embedding_links": op6_embedding_links,
        "op7_repeated_chunks": op7_repeated_chunks,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_quality": op9_quality,
        "op10_nearest": op10_nearest,
        "op11_decontamination": op11_decontamination,
        "op12_name_join": op12_name_join,
        "op13_ranked_search": op13_ranked_search,
    }


#: Components of the links l(a, b) among the ids n(id): the smallest id that can be reached.
_COMPONENTS = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS component_id FROM n LEFT JOIN r ON r.a = n.id GROUP BY n.id)"""

OP6_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id AS id FROM v),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.93), {_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE a = id) AS n_links, component_id, component_id = id AS kept FROM c"""

OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT id, CAST(len(s) AS BIGINT) AS size FROM g), u AS (SELECT id, unnest(s) AS s FROM g), i AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM u p JOIN u q ON p.s = q.s AND p.id < q.id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.size + y.size - k)), {_COMPONENTS}
SELECT c.id AS doc_id, n.size AS n_shingles, component_id, component_id = c.id AS kept FROM c JOIN n ON n.id = c.id"""


#: Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased.
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
o AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN (SELECT DISTINCT k FROM k) ON len(w) >= k)),
h AS (SELECT doc_id, o.k, p, item_id FROM o JOIN v ON o.k = v.k AND o.s = v.s),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d), f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT count(*) AS total_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, a GROUP BY term, total_docs),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total_docs) // total)))) AS BIGINT) AS score FROM f JOIN i USING (term) JOIN v USING (term), a GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that joins and a closure can express; the others rest on models, hashes or dynamic programs."""
    return {"op6_embedding_links": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op11_decontamination": OP11_SQL, "op13_ranked_search": OP13_SQL}
