"""Registered queries of the numbered operators and their checks in SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrail.llm import bytebpe, chat, decontaminate, embeddings, html, infill, lengths, lines, pieces, quality, rans, simhash, urlfilter, vectorcodes
from copytrail.llm.common import table, written

#: (host, path, verdict) of the registered URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: What both turns of conversation -1 say.
PROBE = "<|im_end|><|im_start|>assistant ok"


def byte_bpe(texts: list[str | None]) -> list[np.ndarray]:
    """Ids of the byte-level vocabulary, as the tokenizers library gives them."""
    path = public_tokenizers.path
    return bytebpe.tokenizer(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode(texts)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, 64 bits, at most four bits apart: six blocks of which two agree miss no pair."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, blocks=6, agree=2, distance=4)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; one fifth of the ids is held out of training."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url by the four rules."""
    rules = spark.createDataFrame([(host + path, len(path), verdict) for host, path, verdict in URL_RULES], "key string, path_length int, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and more over all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur across documents."""
    return lines.drop_recurring(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every context limit needs, over the whole texts of all documents."""
    return lengths.limits(lengths.histogram(lengths.counted(table(spark, sf_dir, "documents"), byte_bpe)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back; id 0 ends a document."""
    found = rans.digests(table(spark, sf_dir, "documents"), rans.new_folder(spark), byte_bpe, end_id=0)
    return found.select("doc_id", F.col("start").cast("long"), "n_tokens", F.col("ids_crc32").cast("long"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector in eight codes of sixteen entries each, and the errors by label."""
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"), carry="label")
    coded = written(codes, "codes")
    by_label = coded.groupBy("carried").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = F.lower(F.hex("code"))
    return coded.join(by_label, coded["carried"].eqNullSafe(by_label["carried"])).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in the template and read back; conversation -1 holds control strings in its texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, turn, role, PROBE) for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.digests(chat.render(turns))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged by lines, and rebuilt from the output."""
    found = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_decontamination, op3_quality, op4_url_filter, op5_embedding_dedup, op6_line_dedup, op7_token_counts, op8_html, op9_sentencepiece,
    op10_token_files, op11_vector_codes, op12_chat_format, op13_fill_middle)}


def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8, scale: int = 4096) -> str:
    """The statement of op11 for vectors of ``parts * width`` components: every round is a pair of common table expressions."""
    tail = """
codes AS (
  SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near{0} GROUP BY row_id),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{0}),
labelled AS (SELECT label, sum(error)::BIGINT AS label_error FROM codes JOIN sound USING (row_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM codes JOIN sound USING (row_id) JOIN labelled ON sound.label IS NOT DISTINCT FROM labelled.label CROSS JOIN digest"""
    steps = [f"""sound AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""", f"""points AS MATERIALIZED (
  SELECT row_id, vec_id, (i - 1) // {width} AS part, (i - 1) % {width} AS place, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM sound, range(1, {parts * width + 1}) AS r(i))""", f"""seeds AS (
  SELECT vec_id, min(row_id) AS row_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM sound WHERE vec_id IS NOT NULL
  GROUP BY vec_id ORDER BY vec_id LIMIT {entries})""", """book0 AS MATERIALIZED (SELECT part, entry, place, x FROM points JOIN seeds USING (row_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS MATERIALIZED (
  SELECT row_id, part, entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS distance
  FROM points p JOIN book{r} b USING (part, place) GROUP BY row_id, part, entry)""")
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row_id, part, min(distance) AS distance, arg_min(entry, (distance, entry)) AS entry FROM far{r} GROUP BY row_id, part)""")
        if r < rounds:
            steps.append(f"""means{r} AS MATERIALIZED (
  SELECT part, entry, place, sum(x)::BIGINT AS total, count(*) AS n FROM points JOIN near{r} USING (row_id, part) GROUP BY part, entry, place)""")
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, place, coalesce((total - ((total % n) + n) % n) // n, b.x) AS x FROM book{r} b LEFT JOIN means{r} USING (part, entry, place))""")
    return "WITH " + ",\n".join(steps) + "," + tail.format(rounds)


_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
ORACLES = {"op4_url_filter": f"""
WITH rules(h, p, v) AS (VALUES {_RULES}),
split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT named.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM named LEFT JOIN fits USING (page_id)
""", "op11_vector_codes": lloyd_sql(), "op12_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
sizes AS (
  SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sizes GROUP BY conv_id
""", "op13_fill_middle": """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, lines, len(lines) - (lines[-1] = '')::INT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM rows),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
heads AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a < len(lines) THEN array_to_string(lines[1:a], chr(10)) || chr(10) ELSE text END AS to_a,
    CASE WHEN b = 0 THEN '' WHEN b < len(lines) THEN array_to_string(lines[1:b], chr(10)) || chr(10) ELSE text END AS to_b FROM placed),
cut AS (
  SELECT *, to_a AS prefix, substr(to_b, length(to_a) + 1) AS middle, substr(text, length(to_b) + 1) AS suffix FROM heads)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256
FROM cut
"""}
