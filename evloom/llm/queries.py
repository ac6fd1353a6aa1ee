"""The opN_ queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import mixture as mix
from . import quality_rules as rules
from . import decontamination, prefix_trie, token_files, vector_codes
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .licenses import licenses
from .packing import pack
from .quality_qda import quality
from .secrets import secrets
from .token_count import token_counts

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("EVLOOM_TOKENIZERS", "/opt/tokenizers")

#: Target proportions of the packed windows, by source.
PACKED = {"src0": 8.0} | {f"src{k}": 1.0 for k in range(1, 20)}


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixture(table(spark, sf_dir, "documents"), mix.document_levels(), weights=mix.WEIGHTS, max_epochs=4, seed=7)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", size=1024, end_id=0, weights=PACKED)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", limit=1024)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.drop("spans", "items")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixture": op1_source_mixture,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_files": op7_token_files,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op1_source_mixture": mix.ORACLE,
    "op2_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    # Every two documents that share a shingle; components by transitive closure.
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN n ON n.doc_id = m.doc_id LEFT JOIN k ON k.doc_id = m.doc_id""",
    "op6_quality_rules": rules.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_vector_codes": vector_codes.oracle(parts=8, entries=16, rounds=6),
}
