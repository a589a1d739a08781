"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op1_decontaminate import contaminated
from .op2_pii import personal_data
from .op3_extract import extracted
from .op4_tokens import token_counts
from .op5_warc import round_trip
from .op6_mix import mixture
from .op7_resample import resampled
from .op8_jaccard import jaccard_groups
from .op9_multiindex import near_duplicates
from .op10_language import languages, train

#: The tokenizer that op4_tokens counts with.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(_table(spark, sf_dir, "documents"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(_table(spark, sf_dir, "pages"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass a context of 1024."""
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return round_trip(_table(spark, sf_dir, "pages"), least=0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from each document, sources weighing 5, 2, 1 in turn."""
    return mixture(_table(spark, sf_dir, "documents"))


def op7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents, drawn by how much they read like those labelled good."""
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), share=0.5)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_groups(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op9_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of equal labels, by cosine 0.98."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by models of those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return languages(docs, train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_extract": op3_extract,
    "op4_tokens": op4_tokens,
    "op5_warc": op5_warc,
    "op6_mix": op6_mix,
    "op7_resample": op7_resample,
    "op8_jaccard": op8_jaccard,
    "op9_multiindex": op9_multiindex,
    "op10_language": op10_language,
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES: dict[str, str] = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, ('0x' || h[1:10])::BIGINT AS a, ('0x' || h[11:20])::BIGINT AS b, ('0x' || h[21:30])::BIGINT AS c, ('0x' || h[31:40])::BIGINT AS d FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               list_aggregate(list_transform([a, b, c, d], lambda x: list_aggregate(list_transform(range(8), lambda i: '{_BASE32}'[((x >> (35 - 5 * i)) & 31) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op6_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
        o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS l, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS r,
                     row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i) AS k
              FROM w WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, 2.0::DOUBLE * source_size > l::DOUBLE / r::DOUBLE * weight AS free FROM o),
        f AS (SELECT min(k) AS k FROM c WHERE free),
        t AS (SELECT c.source, c.source_size, CASE WHEN c.k >= f.k THEN (SELECT x.l::DOUBLE / x.r::DOUBLE FROM c x JOIN f y ON x.k = y.k) * c.weight ELSE 2.0::DOUBLE * c.source_size END AS target FROM c, f),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS turns,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
               (turns * size + greatest(0, least(size, floor(target)::BIGINT - turns * source_size - start)))::BIGINT AS taken FROM p""",
    "op8_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, list_aggregate(ws[i:least(i + 2, len(ws))], 'string_agg', ' ') AS g
            FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        reach AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT b.y, r.m FROM reach r JOIN both_ways b ON b.x = r.v)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(m) AS m FROM reach GROUP BY v) c ON c.v = d.doc_id""",
    "op9_multiindex": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        reach AS (SELECT vec_id AS v, vec_id AS m FROM embeddings UNION SELECT l.y, r.m FROM reach r JOIN l ON l.x = r.v),
        c AS (SELECT v, min(m) AS m FROM reach GROUP BY v)
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
        FROM embeddings e JOIN c ON c.v = e.vec_id""",
}
