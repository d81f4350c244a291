"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.llm.bpe import encode_digests
from cyclewise.llm.chat import chat_digests, format_chats, probe
from cyclewise.llm.collocations import collocations
from cyclewise.llm.fingerprints import fingerprint_edits
from cyclewise.llm.jaccard_join import jaccard_components
from cyclewise.llm.mixing import mix_sources
from cyclewise.llm.quality import classify_quality
from cyclewise.llm.substring_dedup import dedup_digests
from cyclewise.llm.token_alignment import align_documents
from cyclewise.llm.token_counts import token_counts
from cyclewise.llm.token_files import token_file_digests
from cyclewise.llm.topk import top_k
from cyclewise.llm.url_filter import filter_urls
from cyclewise.sources.tables import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS size FROM "
    f"(SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, 6))
ORACLE["op11_collocations"] = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
    (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM (""" + _GRAMS + """) GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n.n,
      (1000::HUGEINT * c.a * n.n::HUGEINT) // (l.f::HUGEINT * r.f) AS score
    FROM cuts c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = list_aggregate(c.w[1:k], 'string_agg', ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = list_aggregate(c.w[k + 1:], 'string_agg', ' ')),
weak AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored),
inside AS (SELECT lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase, max(a) AS longer FROM
    (SELECT lang, w, a, size, m, unnest(range(1, size - m + 2)) AS i FROM
        (SELECT lang, w, a, size, unnest(range(2, size)) AS m FROM cand WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT s.* FROM weak s LEFT JOIN inside i USING (lang, phrase)
    WHERE s.pick = 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * s.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\n'))
          + length(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>')) + 15 AS n FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id"""


@query
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    convs = convs.unionByName(probe(spark), allowMissingColumns=True)
    return chat_digests(format_chats(convs, vocabulary("byte_bpe_50k.json"))).drop("n_tokens", "n_loss_tokens")


ORACLE["op12_chat_formatting"] = CHAT_SQL


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"))
