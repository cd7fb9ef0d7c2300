"""The queries of the operators in this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import fill_in_middle, jaccard_join, lexical_search, media, mixing, pii, segmentations, sharding, substring_dedup, token_counts, token_files, toxicity, vector_search
from lumenlog.llm.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over documents: encode, pack at 16 bits, write, read back."""
    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", vocabulary=49_408, end_id=2)
    return token_files.read_token_files(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over documents: tokens of every whole text under the public model's pieces."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over embeddings: every vec_id divisible by 100 against all rows."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over documents: ids of every whole text, and four segmentations sampled without replacement."""
    return segmentations.encoded(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", k=4)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over documents; every fifth id by crc32 is held out of the fit."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over documents: the places of passages that stand in two places or more."""
    return substring_dedup.passages(table(spark, sf_dir, "documents")).drop("key")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over documents: 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40, law="bytes")


#: crc32 of a text's bytes: a table of 256 values by the polynomial's rule, then one step a byte.
_CRC32 = """crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i))
), bt AS (
  SELECT x, list_transform(list_filter(string_split(regexp_replace(hex(encode(x)), '(..)', '\\1 ', 'g'), ' '), lambda h: h <> ''), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)
), cs AS (
  SELECT x, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM bt, crc
)"""

OP7_SQL = f"""
WITH {_CRC32}, k AS (
  SELECT doc_id, x, CAST(strlen(x) + 16 AS BIGINT) AS size, text_crc32, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS key, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS sub
  FROM documents JOIN cs ON coalesce(text, '') = x
), o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY key, sub ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, row_number() OVER (ORDER BY key, sub) - 1 AS number, CAST(sum(size) OVER () AS BIGINT) AS total FROM k
), g AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY key) AS BIGINT) AS own, min(before) OVER (PARTITION BY key) AS first FROM o
), s AS (
  SELECT *, CAST(least(39, CASE WHEN own <= floor(CAST({sharding.TOGETHER} AS DOUBLE) * total / 40) THEN (2 * first + own) * 40 // (2 * total) ELSE (2 * before + size) * 40 // (2 * total) END) AS INTEGER) AS shard FROM g
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, number - min(number) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over documents: sets of 3-word shingles that are 90 parts in 100 alike."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All pairs that share an n-gram, and what links reach; for the oracle's size.
OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), n AS (
  SELECT r, count(*) AS n FROM sh GROUP BY r
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS i ON i.r = x JOIN n AS j ON j.r = y WHERE 100 * c >= 90 * (i.n + j.n - c)
), b AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT r AS x, r AS y FROM w UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x
), least AS (
  SELECT reach.x AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY reach.x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN least USING (r)
"""


#: Target weights of the twenty sources: the first the least, in equal steps.
MIX = {f"src{i}": i + 1 for i in range(20)}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over documents: the place of every document in the mix of sources."""
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX).drop("text")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over documents: FLAC streams, decoded to PCM blocks and read back."""
    return media.media_features(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over documents: the 50 best of them all for each item of benchmark."""
    return lexical_search.ranked(lexical_search.built(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT count(*) AS N, CAST(sum(len(terms)) AS BIGINT) AS L FROM d WHERE len(terms) > 0
), p AS (
  SELECT r, doc_id, own, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS own, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), k
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * own * N) // L))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), k GROUP BY item_id, r, doc_id
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over documents: half of them as fill-in-middle texts, and what is restored from these."""
    made = fill_in_middle.transformed(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(fill_in_middle.restored()).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), r AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 AS spm FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM r
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN x WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM c
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over documents: base identifiers, and what their contexts and values find besides."""
    made = pii.personal_data(table(spark, sf_dir, "documents"))
    return made.select("doc_id", *pii.counts("base"), F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


QUERIES = {"op1_token_files": op1_token_files, "op2_token_counts": op2_token_counts, "op3_top_k": op3_top_k, "op4_segmentations": op4_segmentations, "op5_toxicity": op5_toxicity, "op6_substring_dedup": op6_substring_dedup, "op7_sharding": op7_sharding, "op8_jaccard_join": op8_jaccard_join, "op9_mixing": op9_mixing, "op10_media": op10_media, "op11_lexical_search": op11_lexical_search, "op12_fill_in_middle": op12_fill_in_middle, "op13_pii": op13_pii}
ORACLE: dict[str, str] = {"op3_top_k": OP3_SQL, "op7_sharding": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
