"""op8: verdicts for all page urls."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_reputation import SUFFIXES, judge


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


_LONG = "array_to_string(list_slice(string_split(name, '.'), -2, -1), '.')"
_IS_LONG = f"{_LONG} IN ({', '.join(map(repr, SUFFIXES))})"
_ADDRESS = r"regexp_full_match(name, '\[.*\]|[0-9.]+')"
_DOMAIN = f"CASE WHEN {_ADDRESS} THEN name WHEN {_IS_LONG} THEN array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') ELSE {_LONG} END"
_SUFFIX = f"CASE WHEN {_ADDRESS} THEN name WHEN {_IS_LONG} THEN {_LONG} ELSE string_split(name, '.')[-1] END"

_STRENGTH = """
  SELECT (b + 0.5) / (t + 1) AS m,
         1 / (CASE WHEN k > 1 THEN least(greatest(coalesce((q - b * b / greatest(t, 1) - v * (k - 1)) / nullif(v * (t - nn / greatest(t, 1) - k + 1), 0), 0.5), 0.01), 0.9) ELSE 0.5 END) - 1 AS s
  FROM (SELECT *, (b + 0.5) / (t + 1) * (1 - (b + 0.5) / (t + 1)) AS v
        FROM (SELECT count(*) AS k, coalesce(sum(bad), 0)::DOUBLE AS b, coalesce(sum(n), 0)::DOUBLE AS t, coalesce(sum(bad * bad / n::DOUBLE), 0) AS q, coalesce(sum(n * n::DOUBLE), 0) AS nn
              FROM {rows} WHERE n > 0))
"""

ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fit AS (
  SELECT page_id, first(rule ORDER BY length(rule) DESC) AS rule, first(rverdict ORDER BY length(rule) DESC) AS ruled
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), j AS (
  SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (page_id)
), sums AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name, count(*) FILTER (ruled = 'block') AS bad, count(ruled) AS n FROM j GROUP BY host
), hosts AS (
  SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, bad, n FROM sums
), domains AS (
  SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL
), s1 AS ({_STRENGTH.format(rows='suffixes')}), s2 AS ({_STRENGTH.format(rows='domains')}), s3 AS ({_STRENGTH.format(rows='hosts')}),
a AS (SELECT suffix, n AS sn, (bad + s * m) / (n + s) AS r FROM suffixes, s1),
b AS (SELECT domain, n AS dn, (bad + least(s, sn + 1) * a.r) / (n + least(s, sn + 1)) AS r FROM domains JOIN a USING (suffix), s2),
c AS (SELECT host, (bad + least(s, dn + 1) * b.r) / (n + least(s, dn + 1)) AS r, n + least(s, dn + 1) + 1 AS d FROM hosts JOIN b USING (domain), s3)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN r - 1.645 * sqrt(r * (1 - r) / d) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN c USING (host)
"""
