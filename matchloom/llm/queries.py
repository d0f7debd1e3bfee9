"""Registered queries of the corpus operators, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import alignment, decontaminate, dedup, html_extract, merkle, mix, ngram_join, pii, quality, substring, token_counts, toxicity, warc
from matchloom.llm.common import held_out

#: Deployments pass their own secret; the registered query needs a fixed one.
PII_KEY = "example key"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-tagging CRF trained on the labelled rows that are not held out; scores every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", quality.predicted(0.5).alias("predicted"), "n_lines", "bad_lines")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-tagging CRF trained on the labelled rows that are not held out; scores every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "spans")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivotal dependent rounding of all documents to weights 1, 2, 3 in turn."""
    return mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sort of all documents; of equal texts the largest doc_id stays."""
    return dedup.duplicate_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5-word shingles, Jaccard similarity 0.75."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by surrogates."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key=PII_KEY)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum-cut main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, copied or with other parameters."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per line of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with tampered rows found by their proofs."""
    return merkle.manifest(_table(spark, sf_dir, "documents"), claim=merkle.tampered)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned over all documents."""
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has too, removed from all documents."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op4_toxicity": op4_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op7_pii": op7_pii,
    "op6_html_extract": op6_html_extract,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_substring_dedup": op13_substring_dedup,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_AZ} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op6_html_extract": r"""
        WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
        t AS (SELECT page_id, url, trim(regexp_replace(
            replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'),
            '\s+', ' ', 'g')) AS text FROM p)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
        b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
                ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                [instr('0123456789abcdef', x[i])]), 'string_agg', '') AS bits FROM q)
        SELECT page_id, payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
            16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM b""",
    "op11_merkle_manifest": """
        WITH RECURSIVE bits AS MATERIALIZED (SELECT doc_id, encode(doc_id::VARCHAR) AS b FROM documents),
        table_ AS MATERIALIZED (WITH RECURSIVE c AS (SELECT range AS k, range::UINTEGER AS v, 0 AS s FROM range(256)
            UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END, s + 1 FROM c WHERE s < 8)
          SELECT list(v ORDER BY k) AS t FROM c WHERE s = 8),
        crc AS MATERIALIZED (WITH RECURSIVE c AS (SELECT doc_id, b, 4294967295::UINTEGER AS v, 0 AS i FROM bits
            UNION ALL SELECT doc_id, b, xor(v >> 8, t[1 + xor(v & 255, ascii(decode(b)[i + 1])::UINTEGER)]), i + 1 FROM c, table_ WHERE i < octet_length(b))
          SELECT doc_id, xor(v, 4294967295::UINTEGER)::BIGINT AS t FROM c WHERE i = octet_length(b)),
        f AS (SELECT doc_id, lang, crc.t % 7 = 0 AS hit,
            coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
              || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS front,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS back, n_chars
          FROM documents JOIN crc USING (doc_id)),
        leaf AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(front || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS h,
            sha256(front || coalesce(length((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || back) AS told FROM f),
        ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS k FROM leaf),
        low AS MATERIALIZED (WITH RECURSIVE n AS (SELECT g, 0 AS lv, k, h, count(*) OVER (PARTITION BY g) AS n FROM ord
            UNION ALL SELECT g, lv + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 1) // 2 FROM n WHERE n > 1 GROUP BY g, lv, k // 2)
          SELECT * FROM n),
        roots AS MATERIALIZED (SELECT g, h, lv AS height, row_number() OVER (ORDER BY g) - 1 AS k FROM low WHERE n = 1),
        high AS MATERIALIZED (WITH RECURSIVE n AS (SELECT 0 AS lv, k, h, count(*) OVER () AS n FROM roots
            UNION ALL SELECT lv + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 1) // 2 FROM n WHERE n > 1 GROUP BY lv, k // 2)
          SELECT * FROM n),
        steps AS MATERIALIZED (
          SELECT o.doc_id, l.lv, (o.k >> l.lv) & 1 AS side, coalesce(l2.h, '') AS other
          FROM ord o JOIN roots r ON r.g = o.g JOIN low l ON l.g = o.g AND l.k = o.k >> l.lv AND l.lv < r.height LEFT JOIN low l2 ON l2.g = l.g AND l2.lv = l.lv AND l2.k = xor(l.k, 1)
          UNION ALL
          SELECT o.doc_id, r.height + l.lv, (r.k >> l.lv) & 1, coalesce(l2.h, '')
          FROM ord o JOIN roots r ON r.g = o.g JOIN high l ON l.k = r.k >> l.lv AND l.n > 1 LEFT JOIN high l2 ON l2.lv = l.lv AND l2.k = xor(l.k, 1)),
        way AS MATERIALIZED (SELECT doc_id, list({'s': side, 'o': other} ORDER BY lv) AS w, sha256(string_agg(other, '' ORDER BY lv)) AS p FROM steps GROUP BY doc_id),
        folded AS (WITH RECURSIVE c AS (SELECT o.doc_id, o.told AS h, 1 AS i, coalesce(w, []) AS w FROM ord o LEFT JOIN way USING (doc_id)
            UNION ALL SELECT doc_id, sha256(CASE WHEN w[i].s = 1 THEN w[i].o || h ELSE h || w[i].o END), i + 1, w FROM c WHERE i <= len(w))
          SELECT doc_id, h FROM c WHERE i = len(w) + 1)
        SELECT o.doc_id, o.h AS leaf, r.h AS subroot, t.h AS root, coalesce(w.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
        FROM ord o JOIN roots r ON r.g = o.g JOIN high t ON t.n = 1 LEFT JOIN way w ON w.doc_id = o.doc_id JOIN folded f ON f.doc_id = o.doc_id""",
    "op13_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, hash(list_slice(w, s, s + 49)::VARCHAR) AS a, md5_number_lower(array_to_string(list_slice(w, s, s + 49), ' ')) AS b
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
        late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY a, b) AS least FROM win) WHERE least < doc_id),
        gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS k FROM late),
        per AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
        word AS (SELECT d.doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d JOIN per USING (doc_id)),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k WHERE gone.k IS NULL GROUP BY word.doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
          sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
