"""The corpus operators over the given tables: one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import bpe, fingerprint, jaccard, lines, mixing, pages, phrases, pii, quality, resampling, secrets, suffixes, topk
from lotline.llm.common import read, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text they decode to, as digests."""
    coded = bpe.encode_documents(texts(read(spark, sf_dir, "documents")), WORD_BPE).drop("text")
    back = bpe.decode_documents(coded, WORD_BPE)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_fingerprint")
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, and their likeness."""
    made = fingerprint.fingerprint_documents(fingerprint.with_next(read(spark, sf_dir, "documents")))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: base counts and digest, all spans."""
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    docs = texts(read(spark, sf_dir, "documents"))
    made = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return made.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows' documents, with their language as domain."""
    rows = read(spark, sf_dir, "labels").select("doc_id").distinct()
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(rows, "doc_id", "left_semi")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every whole document."""
    return mixing.mix(read(spark, sf_dir, "documents"), labelled_languages(spark, sf_dir))[0]


@query("op2_lines")
def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the passages of lines that repeat."""
    made = lines.drop_repeated(texts(read(spark, sf_dir, "documents")))
    return made.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone_lines").alias("n_removed_lines"),
                       F.col("__gone_chunks").alias("n_removed_chunks"), "text")


@query("op3_pages")
def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    made = pages.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_main_blocks")


@query("op10_suffixes")
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the strings of 100 bytes that start earlier."""
    made = suffixes.drop_repeated(texts(read(spark, sf_dir, "documents")))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("gone").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_jaccard")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every whole document under Jaccard 0.85 of 4-word shingles."""
    return jaccard.cluster(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_topk")
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 50, among all vectors."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op11_resampling")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every whole document, with the benchmark texts as the target."""
    return resampling.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_PHRASES_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.*, l.a AS l, r.a AS r, (2000000 * cuts.a::HUGEINT) // (l.a + r.a) AS score FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[:cut], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[cut + 1:], ' ')),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
sizes AS (SELECT lang, a, k, w, unnest(range(2, k)) AS size FROM c WHERE k > 2),
inside AS (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM sizes),
around AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS a FROM inside GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE around.a IS NULL OR 100 * around.a::HUGEINT < 80 * lowest.a::HUGEINT),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN n USING (lang) WHERE rank <= 2000"""


@query("op12_phrases", _PHRASES_SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language, over all whole documents."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: base counts and digest, all spans."""
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("spans")).alias("spans"))
