"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm import ann, hard_negatives, language_id, line_dedup, lm_score, media, mixing, near_dedup, packing, secret_scan, token_align, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The place of the tokenizer file that the token queries use."""
    return public_tokenizers.path("word_bpe_49k.json")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose vec_id is divisible by 50."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document under a network trained on all of them."""
    return lm_score.masked_scores(_table(spark, sf_dir, "documents"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op5_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold when read back, with its place in the merged capture history."""
    history = warc.capture_history(_table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat others."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "text")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer())


def op9_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the container of every document holds when read back."""
    return media.media_index(media.media_column(_table(spark, sf_dir, "documents")))


def op10_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a cut, an insertion and a replaced end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(seq: int, start, stop, replacement):
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), replacement.alias("replacement"))

    quarter, half = F.floor(n / 4), F.floor(n / 2)
    edits = F.array(
        edit(0, quarter, quarter + 12, F.lit("")),
        edit(1, half, half, F.concat(F.lit(" "), F.coalesce(F.substring("text", 1, 24), F.lit("")), F.lit(" "))),
        edit(2, n - 40, n, F.upper(F.coalesce(F.substring("text", 5, 30), F.lit("")))),
    )
    return token_counts.count_with_edits(docs.select("doc_id", "text", edits.alias("edits")), word_tokenizer())


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100; where it is divisible by 7 the label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_value_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document and how many sources hold them: a document is a repository, its source the owner."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op13_lockstep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a sentencepiece vocabulary line up in every document."""
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_align.corpus_alignment(_table(spark, sf_dir, "documents"), *files)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan,
        op2_masked_likelihood,
        op3_simhash_bktree,
        op4_nearest_centroid,
        op5_warc_merge,
        op6_entropy_mix,
        op7_fuzzy_lines,
        op8_best_fit,
        op9_iso_media,
        op10_edited_counts,
        op11_four_russians,
        op12_value_owners,
        op13_lockstep_links,
        pipeline,
    )
}

#: The other operators have no equivalent in SQL; tests compare them with brute force.
ORACLE_SQL = {
    "op5_warc_merge": """
        WITH named AS (
          SELECT page_id, coalesce(html, '') AS payload, lower(trim(coalesce(url, ''))) AS u FROM pages),
        hashed AS (
          SELECT *, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS top,
                 list_reduce(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1), '.')), lambda a, b: a || ',' || b) AS host,
                 regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(u, '[?]([^#]*)', 1) AS q FROM named),
        keyed AS (
          SELECT *, host || ')' || CASE WHEN path = '' THEN '/' ELSE path END
                    || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url_key FROM hashed)
        SELECT page_id, strlen(payload) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST((CAST('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to, url_key,
               row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
        FROM keyed""",
    "op11_four_russians": """
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positive AS (
          SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
          AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5""",
    "op12_value_owners": r"""
        WITH patterns AS (
          SELECT * FROM (VALUES
            (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+')) t(kind, pattern)),
        docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
        cut AS (
          SELECT rid, kind, pattern, unnest(regexp_split_to_array(text, pattern)) AS piece, unnest(regexp_extract_all(text, pattern)) AS hit,
                 generate_subscripts(regexp_split_to_array(text, pattern), 1) AS i FROM docs, patterns),
        placed AS (
          SELECT *, CAST(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM cut),
        valued AS (
          SELECT rid, kind, stop - length(hit) AS start, stop, CASE WHEN kind = 0 THEN regexp_extract(hit, pattern, 2) ELSE hit END AS value
          FROM placed WHERE hit IS NOT NULL),
        base AS (SELECT * FROM valued WHERE length(value) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
        left_over AS (SELECT rid, i AS part, piece, stop - length(piece) - coalesce(length(hit), 0) AS origin FROM placed WHERE kind = 0),
        word_cut AS (
          SELECT rid, part, origin, unnest(regexp_split_to_array(piece, '[A-Za-z0-9_+-]{16,}')) AS piece, unnest(regexp_extract_all(piece, '[A-Za-z0-9_+-]{16,}')) AS hit,
                 generate_subscripts(regexp_split_to_array(piece, '[A-Za-z0-9_+-]{16,}'), 1) AS i FROM left_over),
        word_placed AS (
          SELECT rid, hit, origin + CAST(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, part ORDER BY i) AS BIGINT) AS stop FROM word_cut),
        words AS (
          SELECT rid, 3 AS kind, stop - length(hit) AS start, stop, hit AS value FROM word_placed
          WHERE hit IS NOT NULL AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, 'AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}')
            AND len(list_distinct(string_split(hit, ''))) >= 8),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM words),
        owners AS (
          SELECT value, count(DISTINCT coalesce('+' || source, '')) AS owners, count(DISTINCT coalesce('+' || doc_id, '')) AS repositories
          FROM every JOIN docs USING (rid) GROUP BY value),
        spans AS (
          SELECT e.*, o.owners, o.repositories, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span
          FROM every e JOIN owners o USING (value) WHERE kind < 3 OR o.owners <= 1),
        each AS (
          SELECT rid, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(kind = 3) AS n_owned,
                 string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
                 count_if(owners <= 1) AS n_live, count_if(owners = 2) AS n_shared, count_if(owners >= 3) AS n_copied, max(repositories) AS repositories
          FROM spans GROUP BY rid)
        SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_owned, 0) AS BIGINT) AS n_owned,
               CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied,
               CAST(coalesce(repositories, 0) AS BIGINT) AS repositories
        FROM docs LEFT JOIN each USING (rid)""",
}
