"""A query per operator, over the whole tables of a folder; their SQL where there is any."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    byte_bpe,
    captures,
    cotraining,
    forest,
    language,
    licenses,
    likelihood_ratio,
    packing,
    periodic,
    pivots,
    repair,
    surrogates,
    toxicity,
)
from ledgerline.llm.shared import read
from ledgerline.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Of the test queries; who uses the operator brings a secret.
KEY = "test key"


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(read(spark, sf_dir, "embeddings"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return likelihood_ratio.rules(docs, likelihood_ratio.trusted_texts(docs, labels))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "documents"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hexes(raw: bytes | memoryview, edges: np.ndarray) -> list[str]:
        view = memoryview(raw)
        return [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(edges, edges[1:], strict=False)]

    for batch in batches:
        ids, decoded = batch["ids"], batch["decoded"]
        edges = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(np.diff(edges).astype(np.int64)),
                pa.array(hexes(ids.flatten().to_numpy().astype("<u4").tobytes(), 4 * edges)),
                pa.array(sums),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = byte_bpe.ranks(spark, RANKS)
    decoding = byte_bpe.decoding(table)
    return byte_bpe.encode(
        read(spark, sf_dir, "documents"),
        table,
        then=lambda batches: _digests(decoding(batches)),
        schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, KEY, count="n_mentions")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    index = captures.build_index(captures.write_archives(pages))
    found = materialize(captures.look_up(index, captures.keys_of(pages)))
    return captures.read_records(found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by hash; dropped ones are ``absent`` and only name their conversation."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    lot = F.crc32(F.encode(key, "utf-8")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), lot.alias("lot"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "")
        .when(F.col("lot") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("lot") == 0).alias("absent"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged(read(spark, sf_dir, "conversations")), absent="absent")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts made periodic from some word on. A row without doc_id is left alone."""
    if doc_id is None or not words:
        return words
    lot = zlib.crc32(str(doc_id).encode())
    if lot % 10:
        return words
    n, g = len(words), lot // 10
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    unit = words[begin : begin + period]
    return words[:begin] + (unit * (-(-(n - begin) // period)))[: n - begin]


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read(spark, sf_dir, "documents"), planted)
    best = F.col("strongest")
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_pivot_vectors": near_vectors,
        "op2_residual_packing": packed,
        "op3_cotrained_quality": quality,
        "op4_likelihood_ratio_rules": quality_rules,
        "op5_kneser_ney_toxicity": toxic,
        "op6_forest_near_texts": near_texts,
        "op7_distinct_word_bpe": byte_pairs,
        "op8_surrogates": pseudonyms,
        "op9_kneser_ney_language": languages,
        "op10_capture_index": archived,
        "op11_diagonal_licenses": licensed,
        "op12_streamed_repair": repaired,
        "op13_lyndon_runs": periodic_runs,
    }


def license_sql() -> str:
    """The whole license scan in SQL, of any texts in ``documents``."""
    rows = [*((*p, "true") for p in licenses.PHRASES), *((*n, "false") for n in licenses.NOTICES)]
    known = ",\n  ".join(f"({i}, '{label}', {base}, '{text}')" for i, (label, text, base) in enumerate(rows))
    lower = f"translate(%s, '{licenses.UPPER}', '{licenses.LOWER}')"
    words = f"list_filter(string_split_regex({lower}, '{licenses.BREAK}'), lambda x: x <> '')"
    return rf"""
WITH known(template, label, base, body) AS (VALUES
  {known}
), expected AS (
  SELECT template, label, base, {words % "body"} AS w FROM known
), rows AS (
  SELECT row_number() OVER () AS row, doc_id, {words % "coalesce(text, '')"} AS w FROM documents
), word AS (
  SELECT row, unnest(w) AS w, unnest(range(len(w))) AS i FROM rows
), expected_word AS (
  SELECT template, unnest(w) AS w, unnest(range(len(w))) AS t FROM expected
), gram AS (
  SELECT row, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k+2])) AS g,
    unnest(range(len(w) - 2)) AS i FROM rows WHERE len(w) > 2
), expected_gram AS (
  SELECT template, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k+2])) AS g,
    unnest(range(len(w) - 2)) AS t FROM expected
), votes AS (
  SELECT row, template, i - t AS diagonal, count(*) AS votes, min(t) AS low, max(t) AS high
  FROM gram JOIN expected_gram USING (g) GROUP BY ALL
), opened AS (
  SELECT v.*, e.label, e.base, len(e.w) AS size,
    CASE WHEN e.base THEN 1
      WHEN coalesce(diagonal - lag(diagonal) OVER along > {licenses.NEIGHBOURS}, true) THEN 1 ELSE 0 END AS opens
  FROM votes v JOIN expected e USING (template) WINDOW along AS (PARTITION BY row, template ORDER BY diagonal)
), merged AS (
  SELECT *, sum(opens) OVER (PARTITION BY row, template ORDER BY diagonal) AS stretch FROM opened
), reaching AS (
  SELECT row, template, stretch, label, base, size, min(diagonal + low) AS first,
    max(diagonal + high + {licenses.GRAM - 1}) AS last, sum(high - low + {licenses.GRAM}) AS reach
  FROM merged GROUP BY ALL
), matching AS (
  SELECT m.row, m.template, m.stretch, count(DISTINCT e.t) AS matched
  FROM merged m JOIN expected_word e ON e.template = m.template AND e.t BETWEEN m.low AND m.high + {licenses.GRAM - 1}
  JOIN word d ON d.row = m.row AND d.i = m.diagonal + e.t AND d.w = e.w
  GROUP BY ALL
), span AS (
  SELECT r.*, m.matched, m.matched / r.size AS covered
  FROM reaching r JOIN matching m USING (row, template, stretch)
  WHERE m.matched = r.size OR (NOT r.base AND r.reach >= {licenses.COVERED} * r.size AND m.matched / r.size >= {licenses.COVERED})
), widest AS (
  SELECT *, max(struct_pack(last, matched)) OVER (PARTITION BY row, base
    ORDER BY first, last DESC, matched DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM span
), kept AS (
  SELECT * FROM widest WHERE base OR before IS NULL OR before.last < last OR before.matched <= matched
)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(r.w)) AS BIGINT) AS n_words,
  count(*) FILTER (k.base) AS n_base, min(k.first) FILTER (k.base) AS first_word, max(k.first) FILTER (k.base) AS last_word,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label) FILTER (k.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label), '') AS labels, coalesce(max(k.covered), 0) AS score
FROM rows r LEFT JOIN kept k USING (row) GROUP BY r.row"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can tell the whole result.

    The others depend on trained models, keyed hashes or hash functions of the operator.
    """
    return {
        "op1_pivot_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
        "op6_forest_near_texts": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM w
), x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b
  WHERE 100 * c.n >= 75 * (len(p.s) + len(q.s) - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept
FROM s JOIN k ON k.a = s.doc_id""",
        "op10_capture_index": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS m FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM f""",
        "op11_diagonal_licenses": license_sql(),
        "op12_streamed_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS lot
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM lots WHERE lot <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time FROM placed
), faults AS (
  SELECT *, substring(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), inserts(state, letters, lines, then_state) AS (VALUES
  (0, '', CAST([] AS VARCHAR[]), 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', [], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)
), edits(at_state, initial, edit, next_state, price, new_role) AS (VALUES
  (0, NULL, 'D', 0, 4, NULL), (1, NULL, 'D', 1, 4, NULL), (2, NULL, 'D', 2, 4, NULL), (3, NULL, 'D', 3, 4, NULL),
  (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (3, 'u', 'K', 2, 0, NULL),
  (2, 'a', 'K', 3, 0, NULL), (0, NULL, 'R', 2, 3, 'user'), (1, NULL, 'R', 2, 3, 'user'),
  (3, NULL, 'R', 2, 3, 'user'), (2, NULL, 'R', 3, 3, 'assistant')
), ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT w.conv_id, f.i, e.next_state AS state,
      w.cost + 3 * len(s.letters) + e.price + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
      w.audit || s.letters || e.edit AS audit,
      list_concat(list_concat(w.lines, s.lines),
        CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.new_role, f.role) || ':' || f.text] END) AS lines
    FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN inserts s ON s.state = w.state JOIN edits e ON e.at_state = s.then_state
      AND (e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND coalesce(e.initial, f.initial) = f.initial))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), ends AS (
  SELECT w.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
    CAST(w.cost + 3 * len(s.letters) AS BIGINT) AS cost, w.audit || s.letters AS audit,
    sha256(array_to_string(list_concat(w.lines, s.lines), chr(10))) AS repaired_sha256
  FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN inserts s ON s.state = w.state AND s.then_state IN (0, 3)
  WHERE w.i = coalesce(c.n, 0)
)
SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1""",
    }
