"""The registered queries of the numbered operators and their SQL twins.

Every query applies its operator with production parameters to the whole table
it is meant for and derives the columns of its contract from the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import article, decontam, lexical, licences, lines, lzprint, minhash, mixing, negatives, quality, secrets, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MINHASH_SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM tokens
), classes AS (
  SELECT min(doc_id) AS rep, list(doc_id) AS members, any_value(s) AS s, len(any_value(s)) AS n FROM (SELECT doc_id, s, list_sort(s) AS k FROM sets) GROUP BY k
), items AS (
  SELECT rep, n, unnest(s) AS g FROM classes
), both_sides AS (
  SELECT a.rep AS x, b.rep AS y, count(*) AS c, any_value(a.n) AS p, any_value(b.n) AS q
  FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2
), links AS (
  SELECT x, y FROM both_sides WHERE 100 * c >= 75 * (p + q - c)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links), walk AS (
  SELECT rep AS node, rep AS seen FROM classes
  UNION SELECT w.node, e.y FROM walk w JOIN edges e ON w.seen = e.x
), parts AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1)
SELECT d.doc_id, d.n_shingles, p.component AS component_id, d.doc_id = p.component AS kept
FROM (SELECT unnest(CASE WHEN n = 0 THEN [] ELSE members END) AS doc_id, rep, n::BIGINT AS n_shingles FROM classes) d JOIN parts p ON p.node = d.rep
UNION ALL SELECT doc_id, 0, doc_id, true FROM sets WHERE len(s) = 0
"""


@query("op1_minhash_near_dedup", MINHASH_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


DECONTAM_SQL = f"""
WITH words_of AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM item_words WHERE len(w) > 0
), doc_windows AS (
  SELECT d.doc_id, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i, d.w
  FROM words_of d JOIN (SELECT DISTINCT n FROM item_windows) s ON len(d.w) >= s.n
), hits AS (
  SELECT x.doc_id, x.i, x.n, m.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc_windows) x JOIN item_windows m ON x.n = m.n AND x.g = m.g
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM words_of d LEFT JOIN places p USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


@query("op2_benchmark_decontamination", DECONTAM_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '-')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS r, source, source_size, weight, false AS clamped FROM sources
  UNION ALL
  SELECT r + 1, source, source_size, weight,
    clamped OR 3 * source_size < (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0)) * weight
      / sum(weight) FILTER (NOT clamped) OVER ()
  FROM rounds WHERE r < 64
), last_round AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0) AS rest_words, sum(weight) FILTER (NOT clamped) OVER () AS rest_weight
  FROM rounds WHERE r = 64
), targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (rest_words * weight)::DOUBLE / rest_weight::DOUBLE END AS target FROM last_round
), placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(round(t.target) / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, round(target) - whole * source_size - before)))::BIGINT AS taken
FROM placed
"""


@query("op4_mix_sources", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(mixing.mix(table(spark, sf_dir, "documents")))


LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM numbered
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.i, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_QUOTED = """["\']?\\x20*[:=]\\x20*["\']?"""
_KEYS = {kind: "|".join(_either_case(w) for w in names.split()) for kind, names in {
    "assign": "password passwd secret token api_?key", "account": "access_?key_?id client_?id account username login"}.items()}
_PATTERNS = {
    "assign": f"({_KEYS['assign']}){_QUOTED}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "account": f"({_KEYS['account']}){_QUOTED}([A-Za-z0-9+/_.=@-]+)",
    "endpoint": "[a-z][a-z0-9+]*://[A-Za-z0-9.:@_-]+",
    "value": "[A-Za-z0-9+/_=-]{32,}",
}


def _sql_kind(rank: int, kind: str) -> str:
    pattern = _PATTERNS[kind].replace("'", "''")
    valid = {
        "assign": f"length(regexp_extract(m, '{pattern}', 2)) >= 6",
        "access": "length(m) >= 20",
        "hex": "length(m) >= 24",
        "account": f"length(regexp_extract(m, '{pattern}', 2)) >= 3",
        "endpoint": "true",
        "value": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')",
    }[kind]
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, fin - length(m) AS s, fin AS e FROM (
      SELECT doc_id, m, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS fin FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM texts))) WHERE {valid}"""


SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), parts AS ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(_PATTERNS))}
), kept AS (
  SELECT * FROM parts WHERE rank < 3
  UNION ALL
  SELECT * FROM parts p WHERE rank >= 3 AND EXISTS (
    SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.s < p.e + 200 AND p.s - 200 < q.e AND (q.s >= p.e OR p.s >= q.e)
      AND ((p.kind = 'account' AND q.kind IN ('assign', 'hex', 'value')) OR (p.kind = 'endpoint' AND q.kind IN ('assign', 'access', 'hex'))
        OR (p.kind = 'value' AND q.kind IN ('access', 'account'))))
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN joined j USING (doc_id)
"""


@query("op5_linked_secrets", SECRETS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(quality.select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")))


WARC_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM hashed)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM firsts
"""


@query("op7_warc_revisits", WARC_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.roundtrip(table(spark, sf_dir, "pages")))


@query("op9_lz_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_licence_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.find_licences(table(spark, sf_dir, "documents")))


SEARCH_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM split
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark
), postings AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM split) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY t
), impacts AS (
  SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS s FROM postings JOIN weights USING (t), totals
), scores AS (
  SELECT item_id, r, doc_id, sum(s)::BIGINT AS score FROM impacts JOIN wanted USING (t) GROUP BY ALL HAVING sum(s) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), found AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return negatives.mine(vectors)


# The pages of these tables mark their article; the operator doesn't rely on it (tests have pages without the mark).
ARTICLE_SQL = """
WITH parts AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '\\s+', ' ', 'g') AS body FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS body FROM parts
), decoded AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS body FROM plain
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


@query("op13_main_text", ARTICLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
