"""How queries are named and registered. A query takes (spark, sf_dir); its SQL, where there is one, runs on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.sources import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Expressions of DuckDB that several statements share.
CHROM = "CASE WHEN regexp_replace(upper(chrom), '^CHR', '') = 'M' THEN 'MT' ELSE regexp_replace(upper(chrom), '^CHR', '') END"
IMPACT = "CASE impact WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 WHEN 'MODIFIER' THEN 4 ELSE 5 END"
#: sites with key columns: the loop over shared bases written as recursion-free list functions
KEYED = f"""
k0 AS (SELECT *, {CHROM} AS c, list_max([k FOR k IN range(0, least(length(ref), length(alt))) IF right(ref, k) = right(alt, k)]) AS s FROM fx_sites),
k1 AS (SELECT * EXCLUDE (ref, alt), left(ref, length(ref) - s) AS r, left(alt, length(alt) - s) AS a, ref, alt FROM k0),
k2 AS (SELECT *, list_max([k FOR k IN range(0, least(length(r), length(a))) IF left(r, k) = left(a, k)]) AS p FROM k1),
keyed AS (SELECT site_id, c AS chrom, pos + p AS pos, substr(r, p + 1) AS ref, substr(a, p + 1) AS alt, gene_no,
  concat(c, ':', pos + p, ':', substr(r, p + 1), ':', substr(a, p + 1)) AS variant_key FROM k2)"""
#: carriers of calls that pass
CARRIERS = """
carried AS (SELECT *, dp - ad_alt AS ad_ref, CASE WHEN dp > 0 THEN ad_alt / dp::DOUBLE END AS allele_balance, contains(gt, '|') AS phased,
  CASE gt WHEN '1/1' THEN 2 ELSE 1 END AS copies, CASE WHEN gt = '1/1' THEN 'homozygous' WHEN gt = './1' THEN 'half_called' ELSE 'heterozygous' END AS zygosity
  FROM fx_calls WHERE gt <> '0/0')"""


def query(name: str, sql: str | None = None):
    """Register a function under a name, with SQL that must give the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def oracle(views: tuple[str, ...] | list[str], select: str, *ctes: str) -> str:
    """A statement that starts with fixture views and further CTEs."""
    parts = [fixtures.ctes(*views)] if views else []
    named = [*parts, *[c.strip() for c in ctes]]
    return ("WITH " + ", ".join(named) + "\n" if named else "") + select.strip()


class Views:
    """The fixture views of one run, by attribute without fx_: v.sites, v.calls."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self._spark, self._dir, f"fx_{name}")

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def on_views(name: str, views: tuple[str, ...] = (), select: str | None = None, *ctes: str):
    """Register a function of Views; its SQL is put together from views, ctes and select."""

    def put(f):
        query(name, oracle(views, select, *ctes) if select else None)(lambda spark, sf_dir: f(Views(spark, sf_dir)))
        return f

    return put
