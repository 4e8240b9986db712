"""Queries on incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.versions import next_units
from lectern.session import step_dir, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return next_units(table(spark, folder, "units").inputFiles(), table(spark, folder, "readings"), table(spark, folder, "state_runs"), f"{step_dir(spark)}/versions-{uuid.uuid4().hex}")


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
with good as (select distinct run_no, attempt from state_runs where status = 'succeeded'),
taken as (
  select unit_id, unit_fingerprint from (
    select r.unit_id, r.unit_fingerprint,
           row_number() over (partition by r.unit_id order by r.run_no desc, r.noted_at desc nulls last, r.unit_fingerprint desc nulls last) as k
    from readings r join good g on r.run_no = g.run_no and r.attempt = g.attempt where r.unit_id is not null) x
  where k = 1),
now as (
  select unit_id, fingerprint, retired from (
    select unit_id, fingerprint, coalesce(retired, false) as retired,
           row_number() over (partition by unit_id order by revision desc, arrived_at desc nulls last, fingerprint desc, coalesce(retired, false) desc) as k
    from units where unit_id is not null and fingerprint is not null) x
  where k = 1)
select n.unit_id, n.fingerprint
from now n left join taken t on n.unit_id = t.unit_id
where not n.retired and n.fingerprint is distinct from t.unit_fingerprint
""",
}
