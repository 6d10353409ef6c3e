"""The queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    from .packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to WARC archives and read back."""
    from .warc import archive_round_trip

    records = archive_round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and the verdict on every document."""
    from .quality import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from .pii import find_personal_data

    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_found")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of each query vector."""
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 85 per cent or more."""
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and those of them that go because they, or lines within an edit per 12 characters (two at most), occur before."""
    from .linededup import removed_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs, threshold=2, per_edit=12).select(F.col("doc_id").alias("id"), F.col("doc_hash").alias("h"), "removed")
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), lines.alias("n_lines"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    from .tokencount import count_tokens

    counts = count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    from .mixing import mix

    rows = mix(_table(spark, sf_dir, "documents"), seed=0, cycle=3, most=3).where(F.coalesce("copy", F.lit(0)) == 0)
    return rows.select("doc_id", "size", "source_size", "target", F.col("doc_taken").alias("taken"), "position")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    from .suffixdedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"), span=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds of ball k-means with eight centroids."""
    from .ballkmeans import cluster

    found = cluster(_table(spark, sf_dir, "embeddings"), width=64, k=8, rounds=10, scale=1024, seed="3:")
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), scale=256, components=4)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_personal_data": op5_personal_data,
    "op6_top_k": op6_top_k,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_repeats": op11_repeats,
    "op12_clusters": op12_clusters,
    "op13_whitening": op13_whitening,
}



def _clusters_sql(rounds: int = 10, k: int = 8) -> str:
    """All distances in each round, unrolled."""
    steps = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v AS m FROM v ORDER BY c LIMIT {k}
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS a
            FROM v CROSS JOIN c{r} GROUP BY vec_id
        )"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS m
                FROM (SELECT a.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY a.c, i) GROUP BY c
            ) n ON o.c = n.c
        )"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON a.c = c.c
    """


#: SQL for DuckDB; what it can't express is tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op12_clusters": _clusters_sql(),
    "op11_repeats": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), p AS (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50
        ), f AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM p) QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)
        ), l AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f
        ), i AS (SELECT *, count_if(q IS NULL OR p > q + 50) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM l
        ), r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k
        ), s AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM r
        ), g AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM s JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM m
    """,
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS DOUBLE) AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
        ), w AS (
            SELECT *, 3 * total / weight AS ratio, sum(total) OVER () AS words, sum(weight) OVER () AS weights,
                coalesce(sum(3 * total) OVER b, 0) AS stopped, coalesce(sum(weight) OVER b, 0) AS gone
            FROM s WINDOW b AS (ORDER BY 3 * total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (SELECT *, CAST(words - stopped AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level FROM w
        ), t AS (
            SELECT source, total, least(3 * total, coalesce((SELECT max(level) FROM l WHERE level <= ratio), CAST('inf' AS DOUBLE)) * weight) AS target FROM l
        ), c AS (
            SELECT d.*, total, target, unnest([0, 1, 2]) AS k, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), e AS (
            SELECT *, CAST(k * total + cum AS DOUBLE) / nullif(target, 0) AS finish, greatest(0, least(size, CAST(round(target) AS BIGINT) - (k * CAST(total AS BIGINT) + cum - size))) AS part FROM c
        ), p AS (
            SELECT *, sum(part) OVER (ORDER BY finish, source NULLS LAST, h, doc_id NULLS LAST, size, k) - part AS place FROM e WHERE part > 0
        )
        SELECT e.doc_id, CAST(any_value(e.size) AS BIGINT) AS size, CAST(any_value(e.total) AS BIGINT) AS source_size, any_value(e.target) AS target,
            CAST(sum(e.part) AS BIGINT) AS taken, CAST(min(p.place) AS BIGINT) AS position
        FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.k = e.k GROUP BY e.doc_id
    """,
    "op7_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), i AS (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0
        ), sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM i
        ), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
        ), e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
        ), reached AS (
            SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM reached r JOIN e ON e.a = r.node AND r.low < e.b
        )
        SELECT node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(low) AS component_id, node = min(low) AS kept
        FROM reached LEFT JOIN n ON n.doc_id = node GROUP BY node
    """,
    "op6_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
    """,
}
