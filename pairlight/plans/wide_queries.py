"""Queries of the attribute-value operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.operators.wide import read_catalog, resolve_cells, widen
from pairlight.session import table

ENTITY = ("run_id", "model_id", "group_by", "group_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that fills each cell of the wide table."""
    catalog = read_catalog(table(spark, sf_dir, "attr_catalog"))
    cells = resolve_cells(table(spark, sf_dir, "accuracy_facts"), catalog, ENTITY)
    return cells.select(*ENTITY, F.explode("cells").alias("attr_name", "cell")).select(*ENTITY, "attr_name", F.col("cell.record_id").alias("record_id"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per run, model and group."""
    catalog = read_catalog(table(spark, sf_dir, "attr_catalog"))
    return widen(resolve_cells(table(spark, sf_dir, "accuracy_facts"), catalog, ENTITY), catalog, ENTITY)


QUERIES = {"p5_found": p5_found, "p5_wide": p5_wide}

_TEXT = "nullif(regexp_replace(val_text, '^\\s+|\\s+$', '', 'g'), '')"
_NUM = "[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?"
_PLAIN = f"CASE WHEN regexp_full_match(t, '{_NUM}') THEN try_cast(replace(t, ',', '.') AS DOUBLE) END"
_READ = f"""
cells AS (
  SELECT run_id, model_id, group_by, group_name, lower(trim(f.attr_name)) AS attr_name, c.val_type, record_id, recorded_at, {_TEXT} AS t
  FROM accuracy_facts f JOIN attr_catalog c ON lower(trim(f.attr_name)) = lower(trim(c.attr_name))
), typed AS (
  SELECT *, {_PLAIN} AS plain,
    try_cast(regexp_extract(t, '^([-+0-9.eE]+) *%$', 1) AS DOUBLE) / 100 AS pct,
    try_cast(nullif(regexp_extract(t, '^([0-9.]+)/([0-9.]+)$', 1), '') AS DOUBLE) / nullif(try_cast(nullif(regexp_extract(t, '^([0-9.]+)/([0-9.]+)$', 2), '') AS DOUBLE), 0) AS frac,
    coalesce(CASE WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ].*)?') THEN try_strptime(regexp_extract(t, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}'), '%Y-%m-%d') END,
      try_strptime(t, '%Y/%m/%d'), CASE WHEN length(t) = 8 THEN try_strptime(t, '%Y%m%d') END, try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%d %b %Y')) AS day
  FROM cells
), usable AS (
  SELECT *, CASE val_type
    WHEN 'double' THEN coalesce(plain, pct, frac) IS NOT NULL
    WHEN 'int' THEN plain IS NOT NULL AND plain = floor(plain)
    WHEN 'date' THEN day IS NOT NULL
    WHEN 'boolean' THEN coalesce(lower(t) IN ('true','t','yes','y','1','false','f','no','n','0'), false)
    ELSE t IS NOT NULL END AS ok
  FROM typed
), won AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, model_id, group_by, group_name, attr_name ORDER BY recorded_at DESC, record_id DESC) AS rn
  FROM usable WHERE ok
)"""

ORACLE = {
    "p5_found": f"WITH {_READ} SELECT run_id, model_id, group_by, group_name, attr_name, record_id FROM won WHERE rn = 1",
    "p5_wide": f"""WITH {_READ} SELECT run_id, model_id, group_by, group_name,
  max(coalesce(plain, pct, frac)) FILTER (attr_name = 'accuracy') AS accuracy,
  max(day) FILTER (attr_name = 'evaluated_on') :: DATE AS evaluated_on,
  bool_or(lower(t) IN ('true','t','yes','y','1')) FILTER (attr_name = 'matched') AS matched,
  max(coalesce(plain, pct, frac)) FILTER (attr_name = 'max_margin') AS max_margin,
  max(coalesce(plain, pct, frac)) FILTER (attr_name = 'mean_preference_margin') AS mean_preference_margin,
  max(coalesce(plain, pct, frac)) FILTER (attr_name = 'near_failure_rate') AS near_failure_rate,
  max(plain) FILTER (attr_name = 'retries') :: INTEGER AS retries,
  max(t) FILTER (attr_name = 'reviewer_note') AS reviewer_note,
  max(t) FILTER (attr_name = 'scorer_revision') AS scorer_revision,
  max(plain) FILTER (attr_name = 'total') :: INTEGER AS total
  FROM won WHERE rn = 1 GROUP BY ALL""",
}
