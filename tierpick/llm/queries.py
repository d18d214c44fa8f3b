"""The operators on their whole tables, and SQL where it can express them."""

from pyspark.sql import DataFrame, SparkSession

from tierpick.llm import (
    decontam, dedup, html, jaccard, near_vectors, packing, periods, pii, preferences, secrets,
    sharding, toxicity, vector_codes,
)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


@query("op3_html_extraction")
def op3_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query("op4_secret_scans")
def op4_secret_scans(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@query("op6_chat_formatting", """
WITH r AS (
  SELECT conv_id AS pair_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(place) AS last FROM r WHERE role = 'assistant' GROUP BY pair_id),
s AS (
  SELECT pair_id, coalesce(max(CASE WHEN role = 'assistant' THEN place END), max(place)) AS place
  FROM r JOIN l USING (pair_id) WHERE place < last GROUP BY pair_id),
o AS (SELECT pair_id, r.text AS other FROM s JOIN r USING (pair_id, place)),
j AS (
  SELECT pair_id, place, role, CASE WHEN place = last THEN other ELSE text END AS text
  FROM r JOIN l USING (pair_id) JOIN o USING (pair_id) WHERE place <= last),
b AS (
  SELECT coalesce(r.pair_id, j.pair_id) AS pair_id, coalesce(r.place, j.place) AS place,
    r.pair_id IS NOT NULL AS has_c, j.pair_id IS NOT NULL AS has_r, r.role AS role_c,
    r.text AS text_c, j.role AS role_r, j.text AS text_r,
    r.pair_id IS NOT NULL AND j.pair_id IS NOT NULL AND r.role IS NOT DISTINCT FROM j.role
      AND r.text IS NOT DISTINCT FROM j.text AS same
  FROM r FULL JOIN j ON r.pair_id = j.pair_id AND r.place = j.place),
p AS (SELECT *, min(CASE WHEN NOT same THEN place END) OVER (PARTITION BY pair_id) AS split FROM b),
q AS (
  SELECT pair_id, CASE WHEN split IS NULL OR place < split THEN 'prompt' ELSE 'chosen' END AS part,
    place, role_c AS role, text_c AS text FROM p WHERE has_c
  UNION ALL
  SELECT pair_id, 'rejected', place, role_r, text_r FROM p WHERE has_r AND place >= split),
t AS (
  SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS rendered
  FROM q),
u AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (
    PARTITION BY pair_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS start
  FROM t)
SELECT pair_id, part, place, role, rendered, start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(role) + 5 END AS learn_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) END AS learn_end
FROM u""")
def op6_chat_formatting(spark, sf_dir):
    return preferences.formatted(table(spark, sf_dir, "conversations"))


@query("op7_exact_dedup", """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op7_exact_dedup(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op11 as one chain of tables; slow beyond a few thousand vectors."""
    near = """near{r} AS MATERIALIZED (
  SELECT v, part, min({{'d': d, 'e': entry}}) AS best
  FROM (
    SELECT p.v, p.part, e.entry, sum((p.x - e.x) * (p.x - e.x))::BIGINT AS d
    FROM points p JOIN book{r} e ON p.part = e.part AND p.i = e.i
    GROUP BY p.v, p.part, e.entry)
  GROUP BY v, part)"""
    book = """book{s} AS MATERIALIZED (
  SELECT b.part, b.entry, b.i, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, b.x) AS x
  FROM book{r} b LEFT JOIN (
    SELECT p.part, n.best.e AS entry, p.i, sum(p.x)::BIGINT AS total, count(*) AS n
    FROM points p JOIN near{r} n ON p.v = n.v AND p.part = n.part
    GROUP BY p.part, n.best.e, p.i) m ON b.part = m.part AND b.entry = m.entry AND b.i = m.i)"""
    steps = [near.format(r=r) + ",\n" + book.format(r=r, s=r + 1) for r in range(rounds)]
    return """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v, vec_id, label, embedding
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
wide AS (
  SELECT v, unnest(range(len(embedding))) AS k, len(embedding) // 8 AS width, unnest(embedding) AS x
  FROM kept),
points AS MATERIALIZED (
  SELECT v, k // width AS part, k % width AS i, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM wide),
book0 AS MATERIALIZED (SELECT part, v AS entry, i, x FROM points WHERE v < 16),
""" + ",\n".join(steps) + f""",
{near.format(r=rounds)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code,
    CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} JOIN kept USING (v) GROUP BY v, vec_id, label),
sha AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  codebooks_sha256
FROM coded, sha"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark, sf_dir):
    return vector_codes.digest(vector_codes.compress(table(spark, sf_dir, "embeddings")))


@query("op12_near_vectors", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings),
unit AS MATERIALIZED (
  SELECT r, vec_id, len(e) AS n, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e
  FROM v WHERE e IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.r AS u, b.r AS v, b.vec_id AS other FROM unit a JOIN unit b
    ON a.r <> b.r AND a.n = b.n AND list_dot_product(a.e, b.e) >= 0.95),
reach AS (
  SELECT u AS r, v FROM links
  UNION
  SELECT reach.r, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT reach.r, min(v.vec_id) AS least FROM reach JOIN v ON reach.v = v.r GROUP BY reach.r),
many AS (SELECT u AS r, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(vec_id, least), least, vec_id) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(least, vec_id)), false) AS kept
FROM v LEFT JOIN many USING (r) LEFT JOIN least USING (r)""")
def op12_near_vectors(spark, sf_dir):
    return near_vectors.near_copies(table(spark, sf_dir, "embeddings"))


@query("op13_periodic_runs", """
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
      lambda s, b: list_reduce([xor(s, b)] || [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda c, k:
        xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))),
      4294967295::UBIGINT)::BIGINT AS h
  FROM documents),
g AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a
  FROM h),
d AS (
  SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(
    range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    END AS w
  FROM g),
grams AS (
  SELECT r, n, i, array_to_string(w[i - 14:i + 1], ' ') AS gram
  FROM (SELECT r, n, w, unnest(range(15, n)) AS i FROM d WHERE n >= 24)),
points AS (
  SELECT a.r, a.i, a.i - b.i AS q FROM grams a JOIN grams b
    ON a.r = b.r AND a.gram = b.gram AND a.i > b.i AND 3 * (a.i - b.i) <= a.n),
islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM points),
stretches AS (
  SELECT r, q, min(i) - 15 - q AS start, count(*) + 15 + q AS length
  FROM islands GROUP BY r, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
best AS (
  SELECT r, start, length, period FROM (
    SELECT *, row_number() OVER (
      PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs)
  WHERE place = 1),
dropped AS (
  SELECT r, list(DISTINCT i) AS gone
  FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY r),
collapsed AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT d.r, unnest(w) AS word, unnest(range(n)) AS i FROM d) words
  ANTI JOIN (SELECT r, unnest(gone) AS i FROM dropped) g ON words.r = g.r AND words.i = g.i
  GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
  1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(collapsed.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN collapsed USING (r)""")
def op13_periodic_runs(spark, sf_dir):
    return periods.digest(periods.find(periods.with_planted(table(spark, sf_dir, "documents"))))
