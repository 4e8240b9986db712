"""Queries that check links and digests, and receipts of readings.

Bindings: an entry of a unit is an asset whose content is the unit; what the last reading saw of a unit is
stored, what the unit is now is there; a reading of a native cell is a view of it; a reading shows a unit's
whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import transactions as tr
from lectern.operators import verify as vf
from lectern.plans.journal import READS, readings
from lectern.plans.reading import LATEST, units
from lectern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("select unit_id as subject, 'duplicate id' as rule from (select distinct unit_id, fingerprint from units where unit_id is not null) x group by 1 having count(*) > 1")
def duplicate_assets(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand for more than one content."""
    return vf.duplicate_ids(table(spark, d, "units"), "unit_id", "fingerprint")


@query(f"with {LATEST}, {READS}, s as (select distinct unit_id, unit_fingerprint from reads) select distinct s.unit_id as subject, case when l.unit_id is null then 'missing' else 'mismatch' end as rule from s left join latest l on l.unit_id = s.unit_id where l.unit_id is null or l.fingerprint is distinct from s.unit_fingerprint")
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """What was stored of units against what they are."""
    stored = readings(spark, d).select("unit_id", F.col("unit_fingerprint").alias("sha256"))
    return vf.hash_check(stored, units(spark, d).select("unit_id", F.col("fingerprint").alias("sha256")), "unit_id")


@query(f"""with {LATEST}, a as (select distinct entry_id, coalesce(body, '') as body, source_id from index_entries where entry_type = 'unit')
select distinct entry_id as subject, case when l.unit_id is null or coalesce(l.text, '') <> a.body then 'content source' else 'parent' end as rule from a left join latest l on l.unit_id = a.entry_id where l.unit_id is null or coalesce(l.text, '') <> a.body or not coalesce(list_contains(l.source_ids, a.source_id), false)""")
def content_sources(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose unit is missing, has another text, or doesn't belong to their source."""
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    assets = table(spark, d, "index_entries").where("entry_type = 'unit'").select(F.col("entry_id").alias("asset_id"), sha("body").alias("sha256"), F.col("entry_id").alias("content_source_id"), F.col("source_id").alias("owner")).distinct()
    return vf.content_links(assets, units(spark, d, "text", "source_ids").select(F.col("unit_id").alias("source_id"), sha("text").alias("sha256"), F.col("source_ids").alias("parents")))


@query("select distinct source_id as subject, status as rule from sources where status <> 'captured'")
def pending_sources(spark: SparkSession, d: str) -> DataFrame:
    """Warnings: sources that aren't captured whole."""
    return table(spark, d, "sources").where("status <> 'captured'").select(F.col("source_id").alias("subject"), F.col("status").alias("rule")).distinct()


@query(f"with {LATEST}, c as (select unit_id from latest where kind in ('native_cell', 'csv_cell') and not coalesce(retired, false)) select distinct unit_id || ' ' || stage as subject, 'cell' as rule from readings where unit_id in (select unit_id from units where kind in ('native_cell', 'csv_cell')) and unit_id not in (select unit_id from c)")
def cell_views(spark: SparkSession, d: str) -> DataFrame:
    """Readings of cells that are no longer stored."""
    cell = F.col("kind").isin("native_cell", "csv_cell")
    ever = table(spark, d, "units").where(cell).select("unit_id").distinct()
    views = table(spark, d, "readings").join(ever, "unit_id", "left_semi").select(F.concat_ws(" ", "unit_id", "stage").alias("view_id"), "unit_id")
    return vf.cell_views(views, units(spark, d).where(cell & ~F.coalesce("retired", F.lit(False))), ["unit_id"])


RANGES = f"{LATEST}, shown as (select distinct r.run_no, r.attempt, r.unit_id, r.unit_fingerprint, 0 as s, length(coalesce(l.text, ''))::int as e from readings r join latest l on l.unit_id = r.unit_id)"


def shown(spark: SparkSession, d: str) -> DataFrame:
    """(run_no, attempt, unit_id, unit_fingerprint, start, end) of what readings have shown."""
    size = F.length(F.coalesce("text", F.lit("")))
    return table(spark, d, "readings").join(units(spark, d, "text").select("unit_id", size.alias("end")), "unit_id").select("run_no", "attempt", "unit_id", "unit_fingerprint", F.lit(0).alias("start"), "end")


@query(f"""with {RANGES}, h as (select run_no, attempt, count(*) as n, bit_xor(('0x' || substr(sha256(to_json({{'unit_id': unit_id, 'unit_fingerprint': unit_fingerprint, 'start': s, 'end': e}})::varchar), 1, 15))::bigint) as digest from shown group by 1, 2)
select *, 'Q' || substr(sha256(concat_ws(' ', run_no, attempt, n, digest)), 1, 32) as receipt_id from h""")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    """A receipt of each attempt over what it has shown."""
    return vf.receipts(shown(spark, d), ["run_no", "attempt"])


QUOTES = """now as (select unit_id, text, fingerprint, coalesce(retired, false) as retired from latest),
q as (select distinct e.entry_id || ' ' || u.unit_id as ref_id, u.unit_id, u.fingerprint, e.body from (select distinct entry_id, source_id, body from index_entries where entry_type = 'knowledge' and body <> '') e
  join (select distinct unit_id, owner_id, text, fingerprint from units where text <> '') u on u.text = e.body)"""


@query(f"""with {LATEST}, {QUOTES}, x as (select q.*, n.unit_id is not null as known, n.retired, n.fingerprint as f, coalesce(n.text, '') as t, length(body) <= length(coalesce(n.text, '')) as fits from q left join now n on n.unit_id = q.unit_id)
select distinct ref_id as subject, 'unit' as rule from x where not known or retired union select ref_id, 'fingerprint' from x where known and f is distinct from fingerprint union select ref_id, 'range' from x where known and not fits
union select ref_id, 'quote' from x where known and fits and substr(t, 1, length(body)) <> body""")
def validate_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Rules that quotations break: knowledge that repeats a text quotes it from its beginning to its end."""
    k = table(spark, d, "index_entries").where("entry_type = 'knowledge' and body <> ''").select("entry_id", F.col("body").alias("text")).distinct()
    u = table(spark, d, "units").where("text <> ''").select("unit_id", "text", F.col("fingerprint").alias("unit_fingerprint")).distinct()
    refs = k.join(u, "text").select(F.concat_ws(" ", "entry_id", "unit_id").alias("ref_id"), "unit_id", "unit_fingerprint", F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("quote")).distinct()
    return tr.quote_violations(refs, units(spark, d, "text"))
