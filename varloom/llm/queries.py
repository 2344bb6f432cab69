"""Queries opN_<name> over the given tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, exact_dedup, knn_join, line_dedup, mixing, near_dedup, ogg_media, packing, quality, secrets, url_filters, vector_codes, zip_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _buckets(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _halves(docs: DataFrame) -> tuple[Column, Column]:
    """Conditions for two batches of docs: doc_ids above a middle one, and all other rows, those without a doc_id among them."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    above = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    return above, ~above


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into one index, that with the larger doc_ids first, so that its rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    newer, older = _halves(docs)
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", _buckets(spark))
    out = index.ingest_in_turn(docs, [("newer", newer), ("older", older)])
    index.drop()  # the rows of `out` come from tables that were written before
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.repeating(5, 2, 1), share=1.5, max_epochs=2.0, seed="mix")
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP10 = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  substr(sha256('mix' || coalesce('|' || CAST(doc_id AS VARCHAR), '')), 1, 16) AS ord FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
steps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
  coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS full_, (sum(w) OVER rest)::DOUBLE AS free_ FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  rest AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lev AS (SELECT max(level) AS level FROM (SELECT (total - full_) / free_ AS level FROM steps WHERE cap >= (total - full_) / free_ * w ORDER BY cap / w, source NULLS LAST LIMIT 1)),
plan AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM steps, lev),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
runs AS (SELECT doc_id, size, source_size, target, whole, floor(target - whole * source_size + 0.5)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - start)))::BIGINT AS taken FROM runs"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "class_id", "class_size", "texts", "partner_id", "similarity", kept.alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, least_good=0.5, z=1.645)


def _op4_level(name: str, rows: str, mean: str) -> str:
    """A level of the shrinkage: rows of the table with its prior mean m, then its strength k."""
    return f"""{name}m AS MATERIALIZED (SELECT t.*, {mean} AS m FROM {rows}),
{name}k AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 2.0
   ELSE round(1 / least(greatest((sum((good - n * m) * (good - n * m)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.9) - 1, 3) END::DOUBLE AS k FROM {name}m),
{name} AS MATERIALIZED (SELECT t.*, good + k * m AS a, n - good + k * (1 - m) AS b, (good + k * m) / (good + k * m + n - good + k * (1 - m)) AS mean FROM {name}m t, {name}k)"""


_RULE_FITS = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'"
    for v, r in sorted(URL_RULES, key=lambda x: -len(x[1]))
)
_ADDRESS = r"regexp_matches(name, '^([0-9]+([.][0-9]+){3}|\[.*\])$')"
_LONG = ", ".join(f"'{x}'" for x in url_filters.LONG_SUFFIXES)

OP4 = f"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hit AS (SELECT *, CASE {_RULE_FITS} END AS hit FROM urls),
h AS (SELECT host, count(*) AS pages, count(hit) AS n, count(*) FILTER (WHERE starts_with(hit, 'allow')) AS good, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS p FROM hit GROUP BY host),
h2 AS (SELECT host, n::DOUBLE AS n, good::DOUBLE AS good, n AS n_int, good AS good_int,
  CASE WHEN {_ADDRESS} THEN name WHEN array_to_string(p[-2:], '.') IN ({_LONG}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
  CASE WHEN {_ADDRESS} THEN '{url_filters.ADDRESS}' WHEN array_to_string(p[-2:], '.') IN ({_LONG}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM h),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h2 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d0 GROUP BY ALL),
{_op4_level('sl', 's0 t', "(SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s0)")},
{_op4_level('dl', 'd0 t JOIN sl USING (suffix)', 'sl.mean').replace('SELECT t.*, sl.mean', 'SELECT t.suffix, t.domain, t.n, t.good, sl.mean')},
{_op4_level('hl', 'h2 t JOIN dl USING (suffix, domain)', 'dl.mean').replace('SELECT t.*, dl.mean', 'SELECT t.host, t.n, t.good, t.n_int, t.good_int, dl.mean')},
rep AS (SELECT host, n_int, good_int, mean + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM hl)
SELECT page_id, host, path, substr(hit, 7) AS rule, coalesce(substr(hit, 1, 5), CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 good_int AS host_good, n_int AS host_labelled FROM hit JOIN rep USING (host)"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return out.select("doc_id", spans.alias("removed_lines"), F.coalesce("text", F.lit("")).alias("text"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, common.scratch_path(spark, "ledger"), _buckets(spark))
    _, older = _halves(docs)
    for version, rows in (("first", docs.filter(older)), ("second", docs)):  # the second version has the first one's rows and new ones
        ledger.record(rows, "doc_id", version)
        ledger.scan(rows)
    out = ledger.report(docs, ["doc_id"])
    ledger.forget()
    base = F.filter("found", lambda x: x["kind"] < len(secrets.BASE_RULES))
    counts = [F.size(F.filter(F.transform("found", lambda x: x["kind"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE_RULES)]
    return out.select("doc_id", *counts, F.sha2(secrets.span_text(base, secrets.RULES), 256).alias("base_sha256"), secrets.span_text(F.col("found"), secrets.RULES).alias("spans"))


def _op7_kind(k: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, row_no, {k} AS kind, '{rule.kind}' AS name, unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}', 0)) AS whole,
  unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS tested, generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS pos, {rule.least} AS least
  FROM docs WHERE regexp_matches(text, '{pattern}')"""


OP7 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(_op7_kind(k, r) for k, r in enumerate(secrets.RULES))}),
placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row_no, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
  FROM pieces WHERE whole IS NOT NULL),
kept AS (SELECT *, stop - length(whole) AS start FROM placed WHERE length(tested) >= least),
summed AS (SELECT row_no, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (row_no)"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "packages")
    packages = zip_warc.write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return zip_warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p LEFT JOIN t USING (payload_digest)"""


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "media")
    ogg_media.store(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return ogg_media.read_features(spark.read.parquet(path))


def op11_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
scored AS (SELECT q.rid, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM kept q, kept x WHERE q.vec_id % 100 = 0 AND q.rid <> x.rid)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 10"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, codebooks, _ = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(codebooks[-1])).alias("codebooks_sha256"))


def _op12_assigned(t: int) -> str:
    """Assignment to codebooks number t, then the codebooks that follow. All numbers are whole and below 2^53, so that doubles hold them."""
    return f"""a{t} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min(d * 16 + j) AS best FROM (
  SELECT rid, k.p, k.x, c.j, list_inner_product(k.x, k.x) - 2 * list_inner_product(k.x, c.x) + list_inner_product(c.x, c.x) AS d FROM parts k JOIN c{t} c USING (p)) GROUP BY rid, p),
c{t + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(u.x, c.x) AS x FROM c{t} c LEFT JOIN (
  SELECT p, j, list(floor(total / n) ORDER BY i) AS x FROM (SELECT p, j, i, sum(y) AS total, count(*) AS n FROM (
    SELECT p, (best % 16)::BIGINT AS j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{t}) GROUP BY p, j, i) GROUP BY p, j) u ON c.p = u.p AND c.j = u.j)"""


OP12 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
parts AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : p * w + w] AS x FROM kept, (SELECT max(len(v)) // 8 AS w FROM kept), range(8) r(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS j, x FROM parts WHERE rid <= 16),
{", ".join(_op12_assigned(t) for t in range(7))},
codes AS (SELECT rid, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY p) AS code, sum(floor(best / 16))::BIGINT AS error FROM a6 GROUP BY rid),
book AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, j, i)) AS h FROM (SELECT p, j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM c6))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (rid), book"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_quality, op4_url_filters, op5_packing, op6_line_dedup, op7_secret_scans, op8_warc, op9_media_columns, op10_mixing, op11_knn_join, op12_vector_codes, op13_token_alignment)}
ORACLE_SQL = {"op1_exact_dedup": OP1, "op4_url_filters": OP4, "op7_secret_scans": OP7, "op8_warc": OP8, "op10_mixing": OP10, "op11_knn_join": OP11, "op12_vector_codes": OP12}
