"""The registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import chat, codebooks, decontaminate, importance, line_crf, line_dedup, mixing, pii, quality, simhash, token_binary, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.drop("archive", "offset", "length")  # where each record is: fresh names in every run


#: The mixture that op2 plans: as many tokens as there are, and no source seen more often than so many times. On the given
#: tables sources differ by a quarter to two thirds, so this limit, not one of its ends, sets the exponent.
MAX_REPETITION = 1.05


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_tokens = token_counts.tokens(F.col("text"), tokenizer_path("word_bpe_49k.json"))
    plan = mixing.plan(_table(spark, sf_dir, "documents"), budget_share=1.0, max_repetition=MAX_REPETITION, n_tokens=n_tokens)
    return plan.select("doc_id", "source", "n_tokens", "block", "weight", "copies", "places")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents")).drop("keep_runs")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digest(_table(spark, sf_dir, "embeddings"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_token_binary": op9_token_binary,
    "op10_chat": op10_chat,
    "op11_importance": op11_importance,
    "op12_codebooks": op12_codebooks,
    "op13_line_quality": op13_line_quality,
}


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = "'[^\\x20\\x09-\\x0D]+'"


def _number(digits: str) -> str:
    """Hexadecimal text as an integer."""
    return f"list_reduce(list_transform(string_split({digits}, ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT)), lambda a, b: 16 * a + b)"

def _lloyd() -> str:
    """Common table expressions of all rounds over all distances: codebooks b0, b1, ..., the nearest entries a0, a1, ..."""
    parts, entries, rounds = codebooks.PARTS, codebooks.ENTRIES, codebooks.ROUNDS
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codebooks.SCALE} * x::DOUBLE) AS BIGINT)) AS c FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT vec_id, label, part, c[part * (len(c) // {parts}) + 1 : (part + 1) * (len(c) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
  b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS b FROM p QUALIFY e < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT vec_id, label, part, any_value(x) AS x, min(d) AS d, min(d * {entries} + e) % {entries} AS e FROM (SELECT p.*, e, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} USING (part)) GROUP BY vec_id, label, part)")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS b FROM (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY part, e, i) GROUP BY part, e),
  b{k + 1} AS (SELECT part, e, coalesce(m{k}.b, b{k}.b) AS b FROM b{k} LEFT JOIN m{k} USING (part, e))""")
    return ",\n  ".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
    "op7_line_dedup": f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  keyed AS (SELECT *, translate(trim(line, {_BLANK}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM lines),
  firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {line_dedup.MIN_KEY_CHARS} GROUP BY key),
  judged AS (SELECT k.*, coalesce(first < doc_id, FALSE) AS dropped FROM keyed k LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256 FROM judged GROUP BY doc_id""",
    "op8_quality": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
  windows AS (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
  again AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
  repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows JOIN again USING (doc_id, w) CROSS JOIN (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
  worded AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d),
  lines AS (SELECT doc_id, host, text, key, sum(n) AS n FROM (SELECT doc_id, host, text, lower(array_to_string(regexp_extract_all(line, {_WORD}), ' ')) AS key, len(regexp_extract_all(line, {_WORD})) AS n FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE n > 0 GROUP BY doc_id, host, text, key),
  sizes AS (SELECT host, count(DISTINCT text) AS n_docs FROM d GROUP BY host),
  over_limit AS (SELECT host, key, min(doc_id) AS first FROM lines JOIN sizes USING (host) GROUP BY host, key, n_docs HAVING count(DISTINCT text) > {quality.LINE_DOCS} OR (count(DISTINCT text) > {quality.SMALL_DOCS} AND count(DISTINCT text) > n_docs * {quality.LINE_SHARE})),
  lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lost FROM lines JOIN over_limit USING (host, key) WHERE doc_id <> first GROUP BY doc_id),
  counted AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS n_removed_words
    FROM d JOIN worded USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {quality.KEPT_SHARE} * n_words AS kept FROM counted""",
    "op10_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(role || text) + 4 * (length(role || text) - length(replace(role || text, '&', ''))) + 3 * (length(role || text) - length(replace(role || text, '<', ''))) + 5 * (length(role || text) - length(replace(role || text, '[', ''))) + {len(chat.TURN + chat.END) + 1} AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_attachment_tokens FROM e GROUP BY conv_id""",
    "op11_importance": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
  held AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY doc_id, w),
  wanted AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
  -- the table of remainders of the polynomial, then each word's sum byte by byte
  crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
  bytes AS (SELECT w, lower(hex(encode(w))) AS h FROM (SELECT w FROM held UNION SELECT w FROM wanted)),
  buckets AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda k: {_number("h[2 * k + 1 : 2 * k + 2]")})), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket FROM bytes, crc),
  s AS (SELECT bucket, sum(n) AS s FROM held JOIN buckets USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM wanted JOIN buckets USING (w) GROUP BY bucket),
  sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
  gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {importance.BUCKETS}) / ((s + 1)::DOUBLE * (all_t + {importance.BUCKETS})))) AS gain FROM s LEFT JOIN t USING (bucket), sums),
  weights AS (SELECT doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM held JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
  scores AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_number(f"sha256('{importance.SEED}:' || doc_id)[1:8]")} + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
  drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {importance.MIN_WORDS} QUALIFY rank <= {importance.PERCENT} * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN drawn USING (doc_id)""",
    "op12_codebooks": f"""WITH {_lloyd()},
  sha AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{codebooks.ROUNDS}),
  coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codebooks.ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha""",
}
