"""The registered queries of the subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from transmuta.llm import binary_codes, bpe, conversations, factorisation, impact_index, licences, minhash, mixing, phrases, preferences, repeats, toxicity, warc
from transmuta.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_exact_top_k", sql="""
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5""")
def op2(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return impact_index.exact_top(rows, rows.filter("vec_id % 50 = 0"), 5)


@query("op3_licence_scan")
def op3(spark, sf_dir):
    return licences.licence_report(table(spark, sf_dir, "documents"))


@query("op4_preference_format", sql="""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, role, text,
    '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<|' || chr(8203) || 'im_') || chr(10) AS before,
    replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') || '<|im_end|>' AS body
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER own AS place, CAST(sum(length(before) + length(body) + 1) OVER (own ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS until
  FROM t WINDOW own AS (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM placed GROUP BY pair_id),
differ AS (
  SELECT a.pair_id, min(a.place) AS place FROM placed a JOIN placed b ON a.pair_id = b.pair_id AND a.place = b.place AND a.side = 0 AND b.side = 1
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
common AS (SELECT s.pair_id, c, r, coalesce(d.place - 1, least(c, r)) AS n FROM sizes s LEFT JOIN differ d USING (pair_id))
SELECT pair_id, n AS n_common, c - n AS n_chosen, r - n AS n_rejected,
  coalesce(string_agg(before || body || chr(10), '' ORDER BY place) FILTER (side = 0 AND place <= n), '') AS prompt,
  coalesce(string_agg(before || body || chr(10), '' ORDER BY place) FILTER (side = 0 AND place > n), '') AS chosen,
  coalesce(string_agg(before || body || chr(10), '' ORDER BY place) FILTER (side = 1 AND place > n), '') AS rejected,
  coalesce(string_agg(CAST(until - length(body) AS VARCHAR) || ':' || CAST(until AS VARCHAR), ',' ORDER BY place) FILTER (side = 0 AND place > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(until - length(body) AS VARCHAR) || ':' || CAST(until AS VARCHAR), ',' ORDER BY place) FILTER (side = 1 AND place > n AND role = 'assistant'), '') AS rejected_mask
FROM placed JOIN common USING (pair_id) GROUP BY pair_id, n, c, r""")
def op4(spark, sf_dir):
    return preferences.neighbours(table(spark, sf_dir, "conversations"))


@query("op5_one_bit_codes")
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return binary_codes.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


@query("op6_byte_bpe")
def op6(spark, sf_dir, ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN):
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, pattern)


@query("op7_pareto_mixing", sql=r"""
WITH sized AS (
  SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('pareto|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (SELECT named, src, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(size AS HUGEINT) * size) AS DOUBLE) AS squares FROM sized GROUP BY ALL),
weighted AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY named DESC, src) - 1) % 3 AS INTEGER) + 1] AS weight FROM totals),
levels AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) / weight AS full_at,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
       - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY CAST(source_size * 2 AS DOUBLE) / weight, named DESC, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(source_size * 2 AS DOUBLE) / weight, named DESC, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted),
water AS (SELECT level FROM levels WHERE full_at >= level ORDER BY full_at, named DESC, src LIMIT 1),
targets AS (
  SELECT named, src, source_size, squares, least(CAST(2 * source_size AS DOUBLE), coalesce(weight * (SELECT level FROM water), CAST(2 * source_size AS DOUBLE))) AS target FROM levels),
plan AS (
  SELECT *, target - whole * source_size AS rest FROM (
    SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part FROM (
      SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets))),
odds AS (SELECT *, CASE WHEN size > 0 THEN rest * CAST(size AS DOUBLE) / squares ELSE 0 END AS p FROM sized JOIN plan USING (named, src)),
ranked AS (
  SELECT doc_id, size, source_size, target, whole, part, rest,
    CASE WHEN part > 0 THEN sum(size) OVER (PARTITION BY named, src ORDER BY CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 1e300 ELSE (u / (1 - u)) / (p / (1 - p)) END
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
  FROM odds),
marked AS (SELECT *, coalesce(2 * upto - size <= 2 * rest, FALSE) AS sampled FROM ranked)
SELECT doc_id, size, source_size, target, CAST(whole AS BIGINT) + CAST(sampled AS BIGINT) AS copies,
       size * (CAST(whole AS BIGINT) + CAST(sampled AS BIGINT)) AS taken
FROM marked""")
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_warc_dictionary")
def op8(spark, sf_dir):
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    return repeats.digests(table(spark, sf_dir, "documents"))


@query("op11_quality_classifier")
def op11(spark, sf_dir):
    return factorisation.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_phrase_collocations", sql=r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
phrases AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, a AS longer, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand))),
covered AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, t.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN covered v ON v.lang = b.lang AND v.phrase = b.phrase
  WHERE v.longer IS NULL OR 100::HUGEINT * v.longer < 80::HUGEINT * b.a)
WHERE rank <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query("op13_conversation_repair", sql=r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(c) AS BIGINT) for c in string_split(name, '')]),
    lambda crc, b: list_reduce([xor(crc, b), 1::BIGINT, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS fate
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM checked WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- from each state (start, after system, user, assistant), what follows row i: cost, audit, text
ahead AS (
  SELECT conv_id, n + 1 AS i, [{'c': 0, 'a': '', 't': ''}, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)}, {'c': 0, 'a': '', 't': ''}] AS f
  FROM totals
  UNION ALL
  SELECT conv_id, i, [list_sort([h[q], {'c': h[[3, 3, 4, 3][q]].c + 2, 'a': 'I' || h[[3, 3, 4, 3][q]].a, 't': ['user', 'user', 'assistant', 'user'][q] || ':' || chr(10) || h[[3, 3, 4, 3][q]].t},
      CASE WHEN q < 3 THEN {'c': h[4].c + 4, 'a': 'II' || h[4].a, 't': 'user:' || chr(10) || 'assistant:' || chr(10) || h[4].t} END], 'ASC', 'NULLS LAST')[1] for q in [1, 2, 3, 4]]
  FROM (
    SELECT d.conv_id, p.i, [list_sort([{'c': d.f[q].c + 3, 'a': 'D' || d.f[q].a, 't': d.f[q].t},
        CASE WHEN fault NOT IN ('blank', 'duplicate') AND kept[q] > 0 THEN {'c': d.f[kept[q]].c + stay, 'a': 'K' || d.f[kept[q]].a, 't': role || ':' || text || chr(10) || d.f[kept[q]].t} END,
        CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {'c': d.f[[3, 3, 4, 3][q]].c + 2 + stay, 'a': 'R' || d.f[[3, 3, 4, 3][q]].a,
          't': ['user', 'user', 'assistant', 'user'][q] || ':' || text || chr(10) || d.f[[3, 3, 4, 3][q]].t} END], 'ASC', 'NULLS LAST')[1] for q in [1, 2, 3, 4]] AS h
    FROM ahead d JOIN (
      SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS stay,
        CASE left(role, 1) WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS kept FROM faulty) p
      ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i - 1)),
done AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit, f[1].t AS t FROM ahead WHERE i = 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(t, length(t) - 1), '')) AS repaired_sha256
FROM every e LEFT JOIN totals s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id""")
def op13(spark, sf_dir):
    return conversations.repair_report(table(spark, sf_dir, "conversations"))
