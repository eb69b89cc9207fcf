"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_decode
from tidemark.llm.chat import format_turns, read_back, text_parts
from tidemark.llm.decontaminate import leaks
from tidemark.llm.importance import resample
from tidemark.llm.line_runs import without_later_copies
from tidemark.llm.merkle import manifest
from tidemark.llm.pu_quality import quality_scores
from tidemark.llm.repetition import quality_rules
from tidemark.llm.secrets import secret_scan
from tidemark.llm.setsketch import near_components
from tidemark.llm.substrings import remove_repeated_windows
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: DuckDB: crc32 (the public reflected polynomial) of a list of bytes, and the bytes of a string.
_CRC32 = "xor(list_reduce({bytes}, lambda c, b: list_reduce(range(8), lambda t, k: xor(t >> 1, 3988292384 * (t & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"
_BYTES = "list_transform(range(1, octet_length(encode({text})) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"


def _crc32(text: str) -> str:
    return _CRC32.format(bytes=_BYTES.format(text=text))



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document less the later copies of repeated runs."""
    docs = without_later_copies(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[^\x20\x09-\x0D]')) AS places FROM l),
s AS (SELECT doc_id, ls, places, unnest(range(1, len(places) + 1)) AS p FROM e),
k AS (SELECT doc_id, ls, places, p, unnest(range(1, len(places) - p + 2)) AS k FROM s),
w AS (SELECT doc_id, p, k, array_to_string(list_transform(places[p:p+k-1], lambda i: ls[i]), chr(10)) AS run, doc_id * 1000000 + p AS place FROM k),
m AS (SELECT run, min(place) AS first_place FROM w GROUP BY run HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, p + unnest(range(0, k)) AS p FROM w JOIN m USING (run) WHERE place > first_place AND (k > 1 OR strlen(run) >= 40)),
d AS (SELECT e.doc_id, list(places[h.p]) AS gone FROM e JOIN h USING (doc_id) GROUP BY e.doc_id)
SELECT e.doc_id, len(places)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: ls[i]), chr(10))) AS kept_sha256
FROM e LEFT JOIN d USING (doc_id)"""


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one that holds control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_turns(text_parts(turns)))


@_query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document: four words a shingle, similarity of 0.8."""
    return near_components(_table(spark, sf_dir, "documents"))


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and repetition verdict of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or nearly so, with the best window of each pair."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 13-word window of an earlier document covers are removed."""
    return remove_repeated_windows(_table(spark, sf_dir, "documents"))


ORACLE["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS win FROM p WHERE i + 12 <= len(words)),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
h AS (SELECT DISTINCT g.doc_id, g.i + o.o AS i FROM g JOIN m USING (win), (SELECT unnest(range(0, 13)) AS o) o WHERE g.doc_id > m.least),
k AS (SELECT p.doc_id, count(*) FILTER (h.i IS NOT NULL) AS n_removed,
      coalesce(string_agg(p.words[p.i], ' ' ORDER BY p.i) FILTER (h.i IS NULL), '') AS kept
      FROM p LEFT JOIN h USING (doc_id, i) GROUP BY p.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


@_query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan(_table(spark, sf_dir, "documents"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to binary files and read back through the index."""
    folder = f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    files = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    size = F.expr("octet_length(ids) div 4")
    return read_token_files(spark, files).select("doc_id", "start", size.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of every document; one in seven is folded with another n_chars."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(_table(spark, sf_dir, "documents"), tampered)


_FRAMED = "coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(x=x) for x in ("doc_id::VARCHAR", "source", "lang", "{n}::VARCHAR", "text")) + ")"
ORACLE["op12_merkle_manifest"] = rf"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS other FROM documents),
g AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM l GROUP BY lang),
p AS (SELECT tree, n, doc_id, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place
      FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
nodes AS (SELECT tree, 0 AS level, place, n, leaf AS h FROM p
  UNION ALL SELECT tree, any_value(level) + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, place // 2),
subs AS (SELECT tree, h AS subroot, level AS height FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree - 1 AS place, count(*) OVER () AS n, subroot AS h FROM subs
  UNION ALL SELECT any_value(level) + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY place // 2),
r AS (SELECT h AS root, level AS top_height FROM tops WHERE n = 1),
steps AS (SELECT p.tree, p.doc_id, b.level, b.place < a.place AS is_left, b.h FROM p JOIN nodes a ON a.tree = p.tree AND a.n > 1 AND a.place = p.place // (1 << a.level)
    JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.place = xor(a.place, 1)
  UNION ALL SELECT p.tree, p.doc_id, s.height + a.level, b.place < a.place, b.h FROM p JOIN subs s USING (tree) JOIN tops a ON a.n > 1 AND a.place = (p.tree - 1) // (1 << a.level)
    JOIN tops b ON b.level = a.level AND b.place = xor(a.place, 1)),
proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM steps GROUP BY doc_id),
folds AS (SELECT p.doc_id, 0 AS level, p.other AS h, s.height + r.top_height AS height FROM p JOIN subs s USING (tree), r
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(CASE WHEN t.is_left THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), f.height
    FROM folds f LEFT JOIN steps t ON t.doc_id = f.doc_id AND t.level = f.level WHERE f.level < f.height)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM p JOIN subs s USING (tree) LEFT JOIN proofs q USING (doc_id) JOIN folds f ON f.doc_id = p.doc_id AND f.level = f.height, r"""


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn toward the benchmark's words."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op13_importance_resampling"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(words) AS word FROM d),
b AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM u UNION SELECT word FROM q)),
s AS (SELECT bucket, count(*) AS n FROM u JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM q JOIN b USING (word) GROUP BY bucket),
g AS (SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.*, CASE WHEN o.place <= 10 * o.n // 100 THEN o.place END AS "rank" FROM z LEFT JOIN o USING (doc_id)"""
