"""Queries by operator name, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from docgauge.session import Scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


def scope() -> Scope | None:
    """Where the query that is being built keeps tables; it ends with the last reference to the query's result."""
    return _SCOPE.get()


def query(name: str, sql: str | None = None, whole: tuple[str, ...] = ()):
    """Registers a query with its SQL; ``whole`` names sums the SQL engine would otherwise widen past 64 bits."""
    if sql is not None and whole:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in whole)}) FROM ({sql})"

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
            held = Scope()
            token = _SCOPE.set(held)
            try:
                return held.tied(build(spark, sf_dir))
            finally:
                _SCOPE.reset(token)

        QUERIES[name] = scoped
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- shared SQL: the derived tables of captures.py, written from the same rules --------------------

SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


DOCS = """
numbered AS (SELECT doc_id AS d, text, lang AS l, doc_id // 20 AS b, doc_id + CASE WHEN doc_id % 5 = 4 THEN 1000000000 ELSE 0 END AS e FROM documents),
docs AS (
  SELECT d, text, l, 'src' || (b % 20) AS s, CAST(b % 20 AS INTEGER) AS sn, e,
         'docs.src' || (b % 20) || '-' || l || '-' || b || '.example.com' AS site_key,
         'https://' || site_key || '/docs' AS scope_root, scope_root || '/page-' || d AS url, scope_root || '/page-' || e AS entry_url
  FROM numbered),
sites AS (SELECT DISTINCT site_key, scope_root, s, l, sn FROM docs)
"""

PAGE_TEXT = collapse(
    """'Page ' || d || ' ' || text || ' Call GET /v1/items/' || (d % 40) || ' or POST /v1/orders/{order_id}/lines'
    || CASE WHEN d % 6 = 0 THEN ' which is deprecated' ELSE '' END || '. '
    || CASE WHEN d % 8 = 3 THEN 'Last updated: March 3, 2024 ' ELSE '' END
    || CASE WHEN d % 8 = 6 THEN 'May ' ELSE '' END || 'next far here out img mail'"""
)

DECLARED = """
CASE WHEN d % 3 = 0 THEN '2024-' || lpad(CAST(d % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(d % 28 + 1 AS VARCHAR), 2, '0')
     WHEN d % 4 = 1 THEN '2023-' || lpad(CAST(d % 12 + 1 AS VARCHAR), 2, '0') || '-05'
     WHEN d % 8 = 3 THEN '2024-03-03'
     WHEN d % 8 = 6 THEN '2022-05-06'
     WHEN d % 9 = 4 THEN '2015-10-21' END
"""


def refs(source: str) -> str:
    """Links of the derived pages with their order; image and section flags follow from the position."""
    return f"""
refs AS (
  SELECT site_key, d AS page_ord, url AS from_url, 0 AS ref_ord, scope_root || '/page-' || (d + 1) AS url,
         CAST(NULL AS VARCHAR) AS fragment, d + 1 AS k, scope_root FROM {source}
  UNION ALL SELECT site_key, d, url, 1, scope_root || '/page-' || (d + 20), 'top-' || ((d + 20) % 5), d + 20, scope_root FROM {source}
  UNION ALL SELECT site_key, d, url, 2, url, 'top-' || ((d + CASE WHEN d % 10 = 0 THEN 1 ELSE 0 END) % 5), d, scope_root FROM {source}
  UNION ALL SELECT site_key, d, url, 3, 'https://ext' || (d % 13) || '.example.org/p/' || (d % 17), NULL, d, scope_root FROM {source}
  UNION ALL SELECT site_key, d, url, 4, 'https://' || site_key || '/img/' || d || '.png', NULL, d, scope_root FROM {source}),
collected AS (
  SELECT * FROM refs WHERE ref_ord <> 4
  QUALIFY row_number() OVER (PARTITION BY site_key, url, fragment ORDER BY page_ord, ref_ord) = 1)
"""


TARGETS = """
firsts AS (SELECT * FROM collected QUALIFY row_number() OVER (PARTITION BY site_key, url ORDER BY page_ord, ref_ord) = 1),
internal AS (SELECT *, TRUE AS internal FROM firsts WHERE ref_ord < 3
  QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY page_ord, ref_ord) <= 30),
ext AS (SELECT *, regexp_extract(url, '^https://([^/]+)', 1) AS h FROM firsts WHERE ref_ord = 3),
ext1 AS (SELECT *, min(page_ord) OVER (PARTITION BY site_key, h) AS seen,
         row_number() OVER (PARTITION BY site_key, h ORDER BY page_ord) AS in_host FROM ext),
ext2 AS (SELECT *, dense_rank() OVER (PARTITION BY site_key ORDER BY seen) AS host_rank FROM ext1),
external AS (SELECT * EXCLUDE (h, seen, in_host, host_rank), FALSE AS internal FROM ext2 WHERE host_rank <= 8 AND in_host <= 3
  QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY page_ord) <= 15),
targets AS (SELECT * FROM internal UNION ALL SELECT * FROM external),
verdicts AS (
  SELECT t.*, CASE WHEN t.internal AND p.d IS NOT NULL THEN 'sampled'
    WHEN NOT t.internal THEN CASE WHEN (page_ord % 13 + page_ord % 17) % 4 = 0 THEN '404' ELSE '200' END
    WHEN k % 10 = 0 THEN '404' WHEN k % 10 = 1 THEN '200' WHEN k % 10 = 2 THEN '403' WHEN k % 10 = 3 THEN '500'
    WHEN k % 10 = 4 THEN 'dns' WHEN k % 10 = 5 THEN 'timeout' ELSE '200' END AS code
  FROM targets t LEFT JOIN docs p ON t.internal AND t.site_key = p.site_key AND t.k = p.d),
link_out AS (
  SELECT *, CASE WHEN code IN ('sampled', '200') THEN 'ok' WHEN code IN ('404', 'dns') THEN 'broken' ELSE 'unverified' END AS state,
    CASE code WHEN 'sampled' THEN 'sampled page' WHEN 'dns' THEN 'host not found' ELSE code END AS detail
  FROM verdicts),
anchor_refs AS (SELECT * FROM collected WHERE fragment IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY page_ord, ref_ord) <= 15),
anchor_out AS (
  SELECT a.*, CASE
      WHEN p.d IS NOT NULL THEN CASE WHEN a.fragment = 'top-' || (a.k % 5) THEN 'ok' ELSE 'broken' END
      WHEN v.state <> 'ok' THEN v.state
      WHEN a.k % 10 = 0 THEN 'broken' WHEN a.k % 10 IN (2, 3, 4, 5) THEN 'unverified'
      WHEN a.fragment = 'top-' || (a.k % 5) THEN 'ok' ELSE 'broken' END AS state,
    CASE
      WHEN p.d IS NOT NULL THEN CASE WHEN a.fragment = 'top-' || (a.k % 5) THEN 'section found' ELSE 'no such section' END
      WHEN v.state <> 'ok' THEN v.detail
      WHEN a.k % 10 = 0 THEN '404' WHEN a.k % 10 = 2 THEN '403' WHEN a.k % 10 = 3 THEN '500' WHEN a.k % 10 = 4 THEN 'dns'
      WHEN a.k % 10 = 5 THEN 'timeout' WHEN a.fragment = 'top-' || (a.k % 5) THEN 'section found' ELSE 'no such section' END AS detail
  FROM anchor_refs a LEFT JOIN docs p ON a.site_key = p.site_key AND a.k = p.d
  LEFT JOIN link_out v ON v.site_key = a.site_key AND v.url = a.url)
"""

# Sitemap entries in scope: four children, two thirds of the pages.
IN_SCOPE = """
in_scope AS (
  SELECT site_key, e AS d, entry_url AS loc, CASE WHEN d % 2 = 0 THEN '2024-01-' || lpad(CAST(d % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod,
         row_number() OVER (PARTITION BY site_key ORDER BY d % 4, d) AS entry_ord
  FROM docs WHERE d % 3 <> 0 AND sn % 5 <> 4),
chosen AS (
  SELECT site_key, CASE WHEN sn % 5 = 0 THEN scope_root || '/sitemap.xml' ELSE 'https://' || site_key || '/sitemap-index.xml' END AS sitemap_url
  FROM sites WHERE sn % 5 <> 4)
"""

CHECKS = """
checks AS (
  SELECT CAST(o_custkey AS VARCHAR) AS site_key, o_orderkey AS k,
    CASE o_orderstatus WHEN 'F' THEN 'access' WHEN 'O' THEN 'freshness' ELSE 'answerability' END AS grp,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'currency' ELSE 'maintenance' END ELSE 'crawler-access' END AS category,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'fail' WHEN '2' THEN 'warn' WHEN '3' THEN 'pass' WHEN '4' THEN 'skip' ELSE 'unverified' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 7.0 WHEN 2 THEN 4.0 ELSE 2.0 END AS max,
    CASE WHEN left(o_orderpriority, 1) < '4' THEN floor(
      CASE o_orderkey % 4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 7.0 WHEN 2 THEN 4.0 ELSE 2.0 END
      * least(1.0::DOUBLE, coalesce(top, 0.0::DOUBLE) * 10) * 10 + 0.5::DOUBLE) / 10 END AS earned,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Fix ' || o_orderkey END AS fix
  FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_discount) AS top FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
totals AS (
  SELECT site_key,
    floor(coalesce(sum(earned), 0) * 10 + 0.5::DOUBLE) / 10 AS earned,
    floor(coalesce(sum(CASE WHEN earned IS NOT NULL THEN max END), 0) * 10 + 0.5::DOUBLE) / 10 AS possible,
    sum(CASE WHEN status <> 'skip' THEN 1 ELSE 0 END) AS applicable,
    sum(CASE WHEN status = 'unverified' THEN 1 ELSE 0 END) AS unverified,
    bool_or(earned IS NOT NULL AND grp = 'freshness' AND category = 'currency') AS has_currency
  FROM checks GROUP BY 1),
cov AS (
  SELECT CAST(c_custkey AS VARCHAR) AS site_key, c_custkey % 9 + 1 AS pages_tested,
    CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 4 ELSE 0 END AS rate_limited, c_custkey AS c FROM customer)
"""

GRADE = (
    "CASE WHEN score IS NULL THEN NULL WHEN score >= 97 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' "
    "WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
)

REASONS = """
list_filter([
  CASE WHEN pages_tested < 5 THEN 'Only ' || pages_tested || ' page' || CASE WHEN pages_tested = 1 THEN '' ELSE 's' END
       || ' could be read; a score needs at least 5.' END,
  CASE WHEN rate_limited > 0 THEN 'The site refused ' || rate_limited || ' request' || CASE WHEN rate_limited = 1 THEN '' ELSE 's' END
       || ' as too many, so some checks may read low.' END,
  CASE WHEN applicable > 0 AND unverified::DOUBLE / applicable > 0.25 THEN unverified || ' of the ' || applicable
       || ' checks that apply could not be verified.' END], lambda x: x IS NOT NULL)
"""
