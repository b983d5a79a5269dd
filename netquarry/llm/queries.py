"""The queries of this subpackage on the benchmark tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import bpe, cotrain, fingerprint, katz, langid, lattice, mixing, phrases, pii, repeats, simhash, spelling, tokens
from netquarry.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return fingerprint.compare_versions(read(spark, sf_dir, "documents"))


@query
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document."""
    return katz.score(read(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate embeddings."""
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings that occur elsewhere."""
    return repeats.report(read(spark, sf_dir, "documents"))


@query
def op7_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document."""
    return cotrain.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(read(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and back."""
    return bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their more frequent forms and roots."""
    return spelling.variants(read(spark, sf_dir, "documents"))


@query
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.predict(read(spark, sf_dir, "documents"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of every language."""
    return phrases.mine(read(spark, sf_dir, "documents"))


#: Every phrase of up to four words is counted as it stands; only the cut, the scores and the ranks are alike.
ORACLES["op13_phrases"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, w[i:i + k - 1] AS words FROM starts, range(1, 5) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang),
c AS (SELECT lang, words, f AS a FROM f WHERE len(words) > 1 AND f >= 30),
cuts AS (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM c),
scored AS (
  SELECT cuts.*, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.words = cuts.words[:k]
            JOIN f r ON r.lang = cuts.lang AND r.words = cuts.words[k + 1:]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, words[i:i + k - 1] AS words, max(a) AS longer
  FROM c, range(2, 4) t(k), range(1, 4) s(i) WHERE len(words) > k AND i + k - 1 <= len(words) GROUP BY ALL),
kept AS (
  SELECT least.*, array_to_string(least.words, ' ') AS phrase FROM least LEFT JOIN inner_ USING (lang, words)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
