"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.decontam import BEFORE, MASKS, SIMILARITY, WINDOW, leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.html_graph import extract
from tessera.llm.line_dedup import line_digest
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack
from tessera.llm.simple8b import token_digest
from tessera.llm.tool_calls import link_tool_calls
from tessera.llm.toxicity import toxicity
from tessera.llm.warc import archive_digest


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as token-id files, read back; see ``token_digest`` for nulls, repeated ids and empty tables."""
    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model of the labels that are not held out; see ``toxicity.toxicity``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens; see ``packing.pack``."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of ten or more documents, as a digest; see ``line_dedup.line_digest``."""
    return line_digest(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; see ``exact_dedup.exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all conversations, calls with their results; see ``tool_calls.link_tool_calls``."""
    return link_tool_calls(table(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold, in part or as a whole; see ``decontam.leaks``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by way of ARC and WARC archives; see ``warc.archive_digest``."""
    return archive_digest(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and number of near copies of every document; see ``ngram_join.ngram_join``."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``html_graph.extract``."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_tool_calls": op6_tool_calls,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_html_extraction": op10_html_extraction,
}

_MASKED = " ".join(f"WHEN {k} THEN [{', '.join(f'w[i + {o}]' for o in mask)}]" for k, mask in enumerate(MASKS))
_SPANS = f"[{', '.join(str(max(mask)) for mask in MASKS)}]"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"

ORACLE_SQL = {
    "op7_decontamination": f"""
        WITH b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
             d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
             bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b),
             dp AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
             m AS (SELECT unnest(range({len(MASKS)})) AS k),
             bk AS (SELECT item_id, w AS bw, i AS j, k, CASE k {_MASKED} END AS key FROM bp, m WHERE i + {_SPANS}[k + 1] <= len(w)),
             dk AS (SELECT r, doc_id, i, k, CASE k {_MASKED} END AS key FROM dp, m WHERE i + {_SPANS}[k + 1] <= len(w)),
             h AS (SELECT dk.doc_id, d.w AS dw, bw, item_id, i, j FROM dk JOIN bk USING (k, key) JOIN d USING (r)),
             f AS (SELECT doc_id, item_id, len(bw) AS n, list_transform(range(-{BEFORE}, {WINDOW}), lambda x: CASE WHEN i + x >= 1 AND j + x >= 1 AND dw[i + x] = bw[j + x] THEN 1 ELSE 0 END) AS same FROM h),
             g AS (SELECT doc_id, item_id, n, list_max(list_transform(range(1, {BEFORE + 2}), lambda s: list_sum(same[s:s + {WINDOW - 1}]))) AS agreeing FROM f),
             passages AS (SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(agreeing) AS INTEGER) AS agreeing FROM g WHERE agreeing >= ceil(least(n, {WINDOW}) * {SIMILARITY}) GROUP BY 1, 2),
             bi AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS n FROM b),
             bw AS (SELECT item, n, unnest(w) AS word, unnest(range(n)) AS j FROM bi),
             dw AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
             x AS (SELECT r, item, n, i - j AS diagonal, j FROM dw JOIN bw USING (word)),
             y AS (SELECT r, item, n, diagonal, count(*) AS same FROM x GROUP BY ALL HAVING count(*) * 5 >= n * 4),
             pieces AS (SELECT item, n, k, k * n // (n // 5 + 1) AS lo, (k + 1) * n // (n // 5 + 1) AS hi FROM (SELECT item, n, unnest(range(n // 5 + 1)) AS k FROM bi WHERE n > 0) t),
             z AS (SELECT r, item, diagonal, same, k FROM y JOIN x USING (r, item, diagonal) JOIN pieces p USING (item) WHERE j >= lo AND j < hi GROUP BY r, item, diagonal, same, k, hi - lo HAVING count(*) = hi - lo),
             items AS (SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(same) AS INTEGER) AS agreeing FROM z JOIN d USING (r) JOIN bi USING (item) GROUP BY 1, 2)
        SELECT * FROM passages UNION ALL
        SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM passages p WHERE p.doc_id IS NOT DISTINCT FROM i.doc_id AND p.item_id IS NOT DISTINCT FROM i.item_id)""",
    "op9_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0) p),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE both_n >= 0.8 * (nx.n + ny.n - both_n)
                   UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.w = b.w AND a.doc_id <> b.doc_id),
             c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.y FROM c JOIN l ON l.x = c.b),
             k AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM c GROUP BY 1),
             q AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN q USING (doc_id)""",
    "op6_tool_calls": """
        WITH RECURSIVE c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
             l AS (SELECT conv_id, turn, 0 AS level FROM c WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
                   UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 WHERE c.turn >= 2),
             a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND turn >= 1),
             calls AS (
                 SELECT c.conv_id, c.turn, 0 AS idx, 'call' AS kind, l.level, a.conv_id IS NOT NULL AS linked, length(c.text) >= 1 AND c.turn >= 0 AS valid,
                        '{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"depends_on":['
                        || CASE WHEN c.turn >= 2 THEN '"' || c.conv_id || ':' || (c.turn - 2) || '"' ELSE '' END
                        || '],"id":"' || c.conv_id || ':' || c.turn || '","name":"respond","result":'
                        || CASE WHEN a.conv_id IS NULL THEN 'null' ELSE '{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"turn":' || a.turn || '}' END
                        || ',"valid":' || CASE WHEN length(c.text) >= 1 AND c.turn >= 0 THEN 'true' ELSE 'false' END || '}' AS json
                 FROM c JOIN l USING (conv_id, turn) LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1),
             orphans AS (
                 SELECT conv_id, turn, 0, 'orphan', 0, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN),
                        '{"id":"' || conv_id || ':' || (turn - 1) || '","result":{"content":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}}'
                 FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.turn = a.turn - 1)),
             plain AS (
                 SELECT conv_id, turn, 0, 'message', 0, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN),
                        '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}'
                 FROM conversations WHERE role NOT IN ('user', 'assistant') OR role = 'assistant' AND turn < 1)
        SELECT * FROM calls UNION ALL SELECT * FROM orphans UNION ALL SELECT * FROM plain""",
    "op4_line_dedup": r"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
             l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
             k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
             f AS (SELECT k.*, c.key IS NOT NULL AS dropped FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
             g AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
}
