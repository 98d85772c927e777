"""Registered queries: manifest resolution and outcomes."""

from __future__ import annotations

from ..functions.edgar import clean_output_name_sql
from ..operators import manifest as M
from ..sources import derived
from .catalog import query


def _rows_ctes() -> str:
    return f"""{derived.manifest_sql()}, {derived.mapping_sql()}, {derived.archive_listing_sql()},
m AS (SELECT fname AS path FROM manifest),
hits AS (SELECT * FROM mapping WHERE fname IN (SELECT DISTINCT path FROM m)),
resolved AS (SELECT m.path, hits.archive_path FROM m LEFT JOIN hits ON m.path = hits.fname),
rows AS (
  SELECT r.path, r.archive_path,
    CASE WHEN r.archive_path IS NULL THEN 'NO MATCH' WHEN a.archive_path IS NULL THEN 'MISSING'
         WHEN a.error IS NOT NULL THEN 'FAILED' ELSE 'OK' END AS outcome
  FROM resolved r LEFT JOIN archive_listing a ON r.archive_path = a.archive_path)"""


def _rows_sql() -> str:
    return f"""WITH {_rows_ctes()}
SELECT path, archive_path, outcome,
  CASE WHEN outcome = 'OK' THEN {clean_output_name_sql('archive_path')} END AS out_name FROM rows"""


def _rows_df(spark, sf_dir):
    man = M.normalize_manifest(derived.manifest(spark, sf_dir))
    res = M.resolve(man, derived.mapping(spark, sf_dir))
    return M.outcomes(res, derived.archive_listing(spark, sf_dir))


@query("filing_outcomes", ("S2", "J8", "J9", "J11", "S6"), _rows_sql)
def filing_outcomes(spark, sf_dir):
    return _rows_df(spark, sf_dir)


def _counts_sql() -> str:
    return f"""WITH {_rows_ctes()},
named AS (SELECT outcome, CASE WHEN outcome = 'OK' THEN {clean_output_name_sql('archive_path')} END AS out_name
          FROM rows)
SELECT outcome, count(*) AS rows, count(DISTINCT out_name) AS files FROM named GROUP BY outcome"""


@query("outcome_counts", ("J11", "J12"), _counts_sql)
def outcome_counts(spark, sf_dir):
    return M.outcome_counts(_rows_df(spark, sf_dir))
