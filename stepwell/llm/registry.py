"""Registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import (
    bpe,
    html_text,
    jaccard,
    lexical_search,
    license_scan,
    multi_index,
    neighbours,
    packing,
    periodic_runs,
    quality_model,
    quality_rules,
    repeats,
    sharding,
)
from stepwell.llm.common import table

#: Limit of ``sharding_in_small_shards``.
SMALL_SHARD_BYTES = 60_000


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality_model.scored(docs.select("doc_id", "text"), labels)
    doc_id = F.col("_row.doc_id")
    return rows.select(
        doc_id.alias("doc_id"),
        (quality_model.fold(doc_id) == quality_model.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, carry=["doc_id"])
    return judged.select(F.col("_row.doc_id").alias("doc_id"), *quality_rules.MEASURES, "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.assign(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return sharded.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "shard", "depth")


def sharding_in_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, with a limit at which small tables split too, and unevenly."""
    sharded = sharding.assign(table(spark, sf_dir, "documents"), SMALL_SHARD_BYTES, carry=["doc_id"])
    return sharded.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "shard", "depth")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of a tenth of the documents, chosen by id, the words go on with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    )
    words = words.withColumn("n", F.size("words").cast("bigint")).withColumn("g", F.expr("h div 10"))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr(
        "array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)),"
        " int((n - a) div p + 1))), 1, int(n - a))), ' ')"
    )
    return words.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.detect(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.shorter")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    query.__name__: query
    for query in [
        op1_html_extraction,
        op2_license_scan,
        op3_ngram_jaccard_join,
        op4_quality_classifier,
        op5_harmonic_packing,
        op6_suffix_array_dedup,
        op7_byte_bpe,
        op8_nearest_neighbours,
        op9_quality_rules,
        op10_sharding,
        sharding_in_small_shards,
        op11_embedding_near_dedup,
        op12_periodic_runs,
        op13_ranked_lexical_search,
    ]
}


def _shards_sql(limit: int) -> str:
    """The least depth at which the prefix of a document's hash bits fits the limit."""
    return f"""
        WITH k AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                   CAST('0x' || substr(md5(CAST(doc_id AS varchar)), 1, 10) AS bigint) AS h
            FROM documents
        ), sums AS (
            SELECT d, h >> (40 - d) AS p, sum(n_bytes) AS b, count(*) AS n
            FROM k, range(0, 41) AS t(d) GROUP BY ALL
        )
        SELECT k.doc_id, n_bytes,
               substr(lpad(bin(h), 40, '0'), 1, CAST(min(d) AS bigint)) AS shard,
               CAST(min(d) AS integer) AS depth
        FROM k JOIN sums ON p = h >> (40 - d)
        WHERE b <= {limit} OR n = 1
        GROUP BY k.doc_id, n_bytes, h
    """


ORACLE: dict[str, str] = {
    "op10_sharding": _shards_sql(sharding.SHARD_BYTES),
    "sharding_in_small_shards": _shards_sql(SMALL_SHARD_BYTES),
    # all 200-byte strings, in hexadecimal, by their digests; a piece holds 1,000 starts and the bytes that their strings need
    "op6_suffix_array_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), c AS (
            SELECT doc_id, b, substr(h, 2000 * b + 1, 2398) AS s
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS b FROM t)
        ), k AS (
            SELECT doc_id, 1000 * b + unnest(range(0, length(s) // 2 - 199)) AS i,
                   unnest(list_transform(range(0, length(s) // 2 - 199), lambda j: md5_number(substr(s, 2 * j + 1, 400)))) AS f
            FROM c WHERE length(s) >= 400
        ), r AS (
            SELECT doc_id, i FROM k WHERE f IN (SELECT f FROM k GROUP BY f HAVING count(*) > 1)
        ), o AS (
            SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS opens FROM r
        ), n AS (
            SELECT doc_id, i, sum(CAST(opens AS integer)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
        ), x AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY doc_id, run
        ), y AS (
            SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM x
        ), g AS (
            SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last,
                   string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept
            FROM y JOIN t USING (doc_id) GROUP BY doc_id
        )
        SELECT t.doc_id, CAST(length(h) // 2 AS bigint) AS n_bytes, CAST(coalesce(removed, 0) AS bigint) AS n_removed,
               CAST(coalesce(spans, 0) AS bigint) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM t LEFT JOIN g USING (doc_id)
    """,
    # sets of shingles, counts of shared ones, and the smallest id by steps along links
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS l
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
                     WHEN len(l) > 0 THEN [array_to_string(l, ' ')] END) AS sh
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT u, p.w FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = p.w WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), r AS (
            SELECT doc_id, doc_id AS c FROM documents
            UNION
            SELECT l.u, r.c FROM r JOIN l ON l.w = r.doc_id WHERE r.c < l.u
        )
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS bigint) AS n_shingles, min(c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    # all pairs of a label, and the smallest id by steps along links
    "op11_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS double[]) AS e FROM embeddings
        ), l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r AS (
            SELECT vec_id, vec_id AS c FROM v
            UNION
            SELECT l.u, r.c FROM r JOIN l ON l.w = r.vec_id WHERE r.c < l.u
        ), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
        SELECT r.vec_id, CAST(coalesce(any_value(n.n), 0) AS bigint) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
        FROM r LEFT JOIN n ON n.u = r.vec_id GROUP BY r.vec_id
    """,
    "op13_ranked_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
        ), dl AS (SELECT doc_id, CAST(sum(tf) AS bigint) AS n FROM tf GROUP BY ALL
        ), total AS (SELECT count(*) AS nn, CAST(sum(n) AS bigint) AS ll FROM dl
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * count(*) + 1))) AS bigint) AS w
            FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, nn
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS bigint) AS score
            FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN dl USING (doc_id), total
            GROUP BY ALL HAVING score > 0
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank,
                   doc_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
}
