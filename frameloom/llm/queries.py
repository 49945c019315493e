"""Queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import audit, contamination, dac, exact, isomedia, language, near, ngrams, packing, quality, sentencepieces, vectorcodes, viterbi
from frameloom.llm.shared import fold


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    trees = language.train(docs, only_where=fold("doc_id", 5) != 0)
    found = language.identify(docs, trees)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_documents(spark, sf_dir), held_out=fold("doc_id", 7) == 2, deleted=fold("doc_id", 7) == 3)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_documents(spark, sf_dir), size=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    ratings = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, quality.train(docs, ratings))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(dac.write(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.digests(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.flagged(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language, op3_token_counts, op4_lm_score, op5_near_dedup, op6_exact_dedup, op7_quality, op8_packing, op9_token_files, op10_media, op11_filter_audit, op12_decontamination, op13_vector_codes)}

ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    # every document in every order: the step of the first filter that it fails
    "op11_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        f AS (SELECT part, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS C,
                regexp_matches(t, '[#$%&*|]') AS D, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), FALSE) AS E,
                w.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, w.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
        d AS (SELECT part, [A, B, C, D, E] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM f),
        i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        p AS (SELECT *, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, coalesce(list_position(list_transform(o, lambda x: fails[x]), TRUE), 6) AS gone FROM d, o),
        s AS (SELECT part, filter_order, CAST(k.i AS INT) AS step, o[k.i] AS letter, count(*) FILTER (gone > k.i) AS kept, count(*) FILTER (gone = k.i) AS removed, count(*) FILTER (gone < k.i AND fails[o[k.i]]) AS redundant,
                count(*) FILTER (fails[o[k.i]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails, count(*) FILTER (gone = k.i AND good) AS good_lost, count(*) FILTER (gone = k.i AND toxic) AS toxic_lost
            FROM p, i k GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
    """,
    "op12_decontamination": r"""
        WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        it AS (SELECT item, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
        ig AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM it)),
        dg AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM it))),
        hit AS (SELECT r, k, n, item FROM dg JOIN ig USING (n, gram)),
        cov AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM hit) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
    """,
}


def _rounds_sql(rounds: int = 6) -> str:
    """SQL of op13: every part against every entry, round by round."""
    def nearest(books: str) -> str:
        far = f"SELECT x.row, x.part, e.entry, list_sum(list_transform(range(1, len(x.p) + 1), lambda i: (x.p[i] - e.p[i]) * (x.p[i] - e.p[i]))) AS far FROM x JOIN {books} e USING (part)"
        return f"(SELECT row, part, min(struct_pack(far := CAST(far AS BIGINT), entry := entry)) AS best FROM ({far}) GROUP BY row, part)"

    text = """WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        x AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS p FROM v, (SELECT unnest(range(8)) AS part)),
        b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, p FROM x WHERE row <= 16)"""
    for k in range(rounds):
        text += f""",
        n{k} AS MATERIALIZED {nearest(f"b{k}")},
        m{k} AS (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM (SELECT n.part, n.best.entry AS entry, i, CAST(sum(x.p[i]) AS BIGINT) AS total, count(*) AS n FROM n{k} n JOIN x USING (row, part), (SELECT unnest(range(1, 1 + (SELECT max(len(p)) FROM x))) AS i) GROUP BY ALL) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return f"""{text},
        done AS MATERIALIZED {nearest(f"b{rounds}")},
        code AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM done GROUP BY row)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM code JOIN v USING (row)"""


ORACLE_SQL["op13_vector_codes"] = _rounds_sql()
