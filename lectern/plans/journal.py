"""Queries on readings, runs and knowledge: projections, coverage, staleness, validation, evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import integrity as it
from lectern.operators import knowledge as kn
from lectern.operators import units as un
from lectern.plans import sqltext as sq
from lectern.plans.reading import LATEST, units
from lectern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
STAGES = ["initial", "deep"]


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def readings(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each unit and stage."""
    return kn.latest(table(spark, d, "readings"), ["unit_id", "stage"], ["run_no", "attempt", "noted_at"], ["unit_fingerprint", "status"])


#: reads: the last reading of each unit and stage.
READS = """reads as (select unit_id, stage, unit_fingerprint, status, run_no from (
  select *, row_number() over (partition by unit_id, stage order by run_no desc, attempt desc, noted_at desc, unit_fingerprint desc, status desc) as k from readings) r where k = 1)"""
#: covered: the status of each required unit and stage.
COVERED = f"""{LATEST}, {READS}, stages as (select unnest(['initial', 'deep']) as stage),
covered as (select u.unit_id, s.stage, case when r.unit_fingerprint = u.fingerprint then r.status when u.kind = 'gap' then 'gap' when r.status is not null then 'needs_revalidation' else 'unread' end as status, u.owner_id
  from latest u cross join stages s left join reads r on r.unit_id = u.unit_id and r.stage = s.stage where u.required and not coalesce(u.retired, false))"""


def covered(spark: SparkSession, d: str) -> DataFrame:
    return kn.coverage(un.required_units(units(spark, d)), readings(spark, d), STAGES, F.col("kind") == "gap")


@query(f"with {READS} select unit_id, stage, unit_fingerprint, status, run_no from reads")
def latest_reading(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each unit and stage."""
    return readings(spark, d).select("unit_id", "stage", "unit_fingerprint", "status", "run_no")


@query("select user_id, event_type, arg_max(event_id, ts) as event_id, arg_max(value, ts) as value from events group by 1, 2")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type."""
    return kn.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts"], ["event_id", "value"]).drop("ts")


@query("""select user_id, event_type, event_id, version from (
 select *, row_number() over (partition by user_id, event_type order by ts, event_id) as version, count(*) over (partition by user_id, event_type) as n from events) e where version < n""")
def record_history(spark: SparkSession, d: str) -> DataFrame:
    """Events that a later one supersedes, with their version."""
    return kn.history(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("select o_orderkey, o_custkey, dense_rank() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders")
def record_versions(spark: SparkSession, d: str) -> DataFrame:
    """Rows numbered per key."""
    return kn.versions(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""select run_no, attempt, rule from (select run_no, attempt, case when event_sha256 is null then 'no digest' when revision <= b then 'revision doesn''t grow' when event_sha256 = s then 'digest repeated' end as rule from (
 select *, lag(revision) over (order by run_no, attempt) as b, lag(event_sha256) over (order by run_no, attempt) as s from (select distinct run_no, attempt, revision, event_sha256 from state_runs) x) y) z where rule is not null""")
def journal_chain(spark: SparkSession, d: str) -> DataFrame:
    """Attempts that break the chain of revisions and digests; the table is of a fixed size."""
    rows = table(spark, d, "state_runs").select("run_no", "attempt", "revision", "event_sha256").distinct()
    return kn.chain_violations(rows, [], ["run_no", "attempt"], "revision", "event_sha256").select("run_no", "attempt", "rule")


@query(f"with {COVERED} select unit_id, stage, status from covered")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """The status of every required unit and stage."""
    return covered(spark, d)


@query(f"""with {COVERED}, c as (select stage, count(*) as total, count(*) filter (where status not in ('unread', 'needs_revalidation', 'gap')) as actually_read, count(*) filter (where status = 'gap') as gap, count(*) filter (where status in ('unread', 'needs_revalidation')) as unread_or_stale from covered group by 1)
select *, actually_read + gap as accounted_for, unread_or_stale = 0 as complete from c""")
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts per stage."""
    return kn.stage_summary(covered(spark, d))


@query(f"""with {COVERED} select case when count(*) filter (where stage = 'initial' and status in ('unread', 'needs_revalidation')) > 0 then 'initial' else 'deep' end as current_stage,
 case when count(*) filter (where status in ('unread', 'needs_revalidation')) = 0 and count(*) filter (where stage = 'deep' and status = 'gap') = 0 then 'ready' else 'not_ready' end as qa_readiness,
 (select count(distinct entry_id) from index_entries where entry_type = 'knowledge') as knowledge_records from covered""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """The overall state, one row."""
    pending = F.col("status").isin("unread", "needs_revalidation")
    state = covered(spark, d).agg(
        F.when(F.count_if(pending & (F.col("stage") == "initial")) > 0, "initial").otherwise("deep").alias("current_stage"),
        F.when((F.count_if(pending) == 0) & (F.count_if((F.col("stage") == "deep") & (F.col("status") == "gap")) == 0), "ready").otherwise("not_ready").alias("qa_readiness"),
    )
    records = table(spark, d, "index_entries").where("entry_type = 'knowledge'").agg(F.count_distinct("entry_id").alias("knowledge_records"))
    return state.crossJoin(records)  # one row each


@query(f"with {COVERED}, p as (select * from covered where stage = 'initial' and status in ('unread', 'needs_revalidation')) select unit_id, stage, status, greatest((select count(*) from p) - 8, 0) as remaining from p order by unit_id limit 8")
def next_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next units to read (a batch of 8 is the feature)."""
    return kn.next_batch(covered(spark, d), "initial", ["unit_id"])


@query(f"with {COVERED} select distinct unit_id from covered where status = 'gap'")
def gap_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with a gap in any stage."""
    return covered(spark, d).where("status = 'gap'").select("unit_id").distinct()


@query(f"with {COVERED} select owner_id, bool_or(status in ('unread', 'needs_revalidation')) as any_pending, bool_and(status = 'gap') as all_gap from covered group by 1")
def any_pending(spark: SparkSession, d: str) -> DataFrame:
    """Per owner whether anything is pending, and whether all is a gap."""
    rows = covered(spark, d).join(units(spark, d).select("unit_id", "owner_id"), "unit_id")
    return rows.groupBy("owner_id").agg(F.bool_or(F.col("status").isin("unread", "needs_revalidation")).alias("any_pending"), F.bool_and(F.col("status") == "gap").alias("all_gap"))


@query("""select distinct entry_id, case when coalesce(trim(body), '') = '' then 'no content' else 'no scope' end as unknown from index_entries where entry_type = 'knowledge' and (coalesce(trim(body), '') = '' or coalesce(trim(section), '') = '')""")
def unresolved_records(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge that lacks content or scope."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = table(spark, d, "index_entries").where("entry_type = 'knowledge'")
    return rows.where(empty("body") | empty("section")).select("entry_id", F.when(empty("body"), "no content").otherwise("no scope").alias("unknown")).distinct()


#: refs: what rests on a unit version: knowledge that repeats its text, and runs that read it.
REFS = """refs as (select distinct k.entry_id, u.unit_id, u.fingerprint from (select distinct entry_id, source_id, body from index_entries where entry_type = 'knowledge' and body <> '') k
  join (select distinct unit_id, owner_id, text, fingerprint from units where text <> '') u on k.body = u.text union select 'run ' || run_no, unit_id, unit_fingerprint from readings)"""


def references(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "index_entries").where("entry_type = 'knowledge' and body <> ''").select("entry_id", F.col("body").alias("text")).distinct()
    u = table(spark, d, "units").where("text <> ''").select("unit_id", "text", "fingerprint").distinct()
    read = table(spark, d, "readings").select(F.concat(F.lit("run "), "run_no").alias("entry_id"), "unit_id", F.col("unit_fingerprint").alias("fingerprint"))
    return k.join(u, "text").select("entry_id", "unit_id", "fingerprint").unionByName(read).distinct()


def judged(spark: SparkSession, d: str) -> DataFrame:
    """References with what is wrong with them: null, or missing, retired or changed."""
    now = units(spark, d).select("unit_id", F.col("fingerprint").alias("now"), F.coalesce("retired", F.lit(False)).alias("retired"), F.lit(True).alias("known"))
    wrong = F.when(F.col("known").isNull(), "missing").when(F.col("retired"), "retired").when(~F.col("fingerprint").eqNullSafe(F.col("now")), "changed")
    return references(spark, d).join(now, "unit_id", "left").withColumn("wrong", wrong)


JUDGED = f"""{LATEST}, {REFS}, judged as (select r.*, case when l.unit_id is null then 'missing' when coalesce(l.retired, false) then 'retired' when r.fingerprint is distinct from l.fingerprint then 'changed' end as wrong from refs r left join latest l on l.unit_id = r.unit_id)"""


@query(f"with {JUDGED} select entry_id, count(distinct unit_id) filter (where wrong is null) as available, count(distinct unit_id) filter (where wrong is not null) as unavailable from judged group by 1")
def evidence_expand(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each knowledge record, available and not."""
    return judged(spark, d).groupBy("entry_id").agg(F.count_distinct(F.when(F.col("wrong").isNull(), F.col("unit_id"))).alias("available"), F.count_distinct(F.when(F.col("wrong").isNotNull(), F.col("unit_id"))).alias("unavailable"))


@query(f"with {JUDGED} select entry_id, unit_id, fingerprint, wrong from judged where wrong is not null")
def stale_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to units that are missing, retired or changed."""
    return judged(spark, d).where("wrong is not null").select("entry_id", "unit_id", "fingerprint", "wrong")


@query(f"""with {JUDGED} select distinct entry_id || ' ' || unit_id as subject, wrong as rule from judged where wrong is not null
union select distinct entry_id || ' ' || unit_id, 'no fingerprint' from judged where fingerprint is null""")
def validate_refs(spark: SparkSession, d: str) -> DataFrame:
    """Rules that references break."""
    rules = {name: F.col("wrong") == name for name in ("missing", "retired", "changed")} | {"no fingerprint": F.col("fingerprint").isNull()}
    return kn.violations(judged(spark, d), F.concat_ws(" ", "entry_id", "unit_id"), rules)


@query(f"with {LATEST}, {READS} select r.unit_id, r.stage, r.unit_fingerprint from reads r where not exists (select 1 from latest l where l.unit_id = r.unit_id and l.fingerprint = r.unit_fingerprint)")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose unit has another fingerprint now."""
    now = units(spark, d).select("unit_id", F.col("fingerprint").alias("unit_fingerprint"))
    return it.missing(readings(spark, d).select("unit_id", "stage", "unit_fingerprint"), now, ["unit_id", "unit_fingerprint"])


@query("""with v as (select o_orderkey, o_custkey, dense_rank() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders), m as (select o_custkey, max(version) as top from v group by 1)
select v.o_orderkey, v.o_custkey, v.version, m.top as current from v join m on v.o_custkey = m.o_custkey where v.version <> m.top""")
def stale_deps(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies on a version that isn't the current one."""
    rows = kn.versions(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
    top = rows.groupBy("o_custkey").agg(F.max("version").alias("current"))
    return rows.join(top, "o_custkey").where("version <> current").select("o_orderkey", "o_custkey", "version", "current")


@query(f"""with {JUDGED}, gone as (select distinct entry_id, source_id from index_entries where entry_type = 'knowledge' and source_id is not null and source_id not in (select source_id from sources)),
reasons as (select entry_id, 'unit ' || wrong || ': ' || unit_id as reason from judged where wrong is not null union select entry_id, 'source missing: ' || source_id from gone
  union select distinct entry_id, 'review pending' from index_entries where entry_type = 'knowledge' and review_status is null)
select entry_id, string_agg(reason, '; ' order by reason) as reasons from reasons group by 1""")
def stale_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons for which a knowledge record is stale, sorted."""
    k = table(spark, d, "index_entries").where("entry_type = 'knowledge'")
    one = judged(spark, d).where("wrong is not null").select("entry_id", F.concat(F.lit("unit "), "wrong", F.lit(": "), "unit_id").alias("reason"))
    gone = it.missing(k.where("source_id is not null").select("entry_id", "source_id").distinct(), table(spark, d, "sources"), ["source_id"]).select("entry_id", F.concat(F.lit("source missing: "), "source_id").alias("reason"))
    open_ = k.where("review_status is null").select("entry_id", F.lit("review pending").alias("reason"))
    return one.unionByName(gone).unionByName(open_).groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


CONTAINED = """edges as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 's' || s_suppkey, 'n' || s_nationkey from supplier)"""


def contained(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, b, x, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    return pair("nation", "n", "r", "n_nationkey", "n_regionkey").unionByName(pair("customer", "c", "n", "c_custkey", "c_nationkey")).unionByName(pair("supplier", "s", "n", "s_suppkey", "s_nationkey"))


@query(f"""with recursive {CONTAINED}, ids as (select child as id from edges union select parent from edges), walk as (select id, id as ancestor from ids union select w.id, e.parent from walk w join edges e on e.child = w.ancestor)
select id, ancestor from walk""")
def source_closure(spark: SparkSession, d: str) -> DataFrame:
    """All containers of everything contained."""
    return kn.closure(contained(spark, d))


@query(f"""with recursive {CONTAINED}, seeds as (select 's' || s_suppkey as id, 'balance below zero' as reason from supplier where s_acctbal < 0), depends as (select parent as id, child as "on" from edges where child like 's%' union select child, parent from edges where child like 'c%'),
stale as (select id, reason from seeds union select d.id, 'depends on ' || d."on" from stale s join depends d on d."on" = s.id) select id, reason from stale""")
def transitive_stale(spark: SparkSession, d: str) -> DataFrame:
    """What is stale, directly or because it depends on stale things, with every reason."""
    edges = contained(spark, d)
    depends = edges.where("child like 's%'").select(F.col("parent").alias("id"), F.col("child").alias("on")).unionByName(edges.where("child like 'c%'").select(F.col("child").alias("id"), F.col("parent").alias("on")))
    seeds = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("balance below zero").alias("reason"))
    return kn.spread(seeds, depends)


@query("select source_id, section, count(distinct body) as bodies from index_entries where entry_type = 'knowledge' and source_id is not null and section is not null group by 1, 2 having count(distinct body) >= 2")
def conflict_guard(spark: SparkSession, d: str) -> DataFrame:
    """Scopes with two or more different statements."""
    rows = table(spark, d, "index_entries").where("entry_type = 'knowledge' and source_id is not null and section is not null")
    return rows.groupBy("source_id", "section").agg(F.count_distinct("body").alias("bodies")).where("bodies >= 2")


@query("""with k as (select distinct entry_id, kind, name, section, body, review_status from index_entries where entry_type = 'knowledge')
select distinct entry_id as subject, 'id shape' as rule from k where not regexp_matches(entry_id, '^[A-Za-z][A-Za-z0-9_.-]{0,80}$')
union select entry_id, 'name' from k where coalesce(trim(name), '') = '' union select entry_id, 'scope' from k where coalesce(trim(section), '') = '' union select entry_id, 'claims' from k where coalesce(trim(body), '') = ''
union select entry_id, 'review status' from k where coalesce(review_status, '') not in ('unreviewed', 'source_checked', 'human_reviewed')""")
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Rules that knowledge records break."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"id shape": ~F.col("entry_id").rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,80}$"), "name": blank("name"), "scope": blank("section"), "claims": blank("body"), "review status": ~F.coalesce("review_status", F.lit("")).isin("unreviewed", "source_checked", "human_reviewed")}
    return kn.violations(table(spark, d, "index_entries").where("entry_type = 'knowledge'"), F.col("entry_id"), rules)


@query(f"""with {LATEST}, x as (select r.unit_id || ' ' || r.stage || ' ' || r.run_no || ' ' || r.attempt as subject, r.stage, r.status, r.notes, l.unit_id as known, l.retired, l.required, l.kind from readings r left join latest l on l.unit_id = r.unit_id)
select distinct subject, 'stage' as rule from x where stage not in ('initial', 'deep') union select subject, 'status' from x where not (status in ('read', 'gap') and stage = 'initial' or status in ('deep_read', 'gap') and stage = 'deep')
union select subject, 'notes' from x where coalesce(trim(notes), '') = '' union select subject, 'unit' from x where known is null or coalesce(retired, false) or not coalesce(required, false) union select subject, 'blocked' from x where kind = 'gap' and status <> 'gap'""")
def validate_reads(spark: SparkSession, d: str) -> DataFrame:
    """Rules that readings break."""
    now = units(spark, d).select("unit_id", "retired", "required", "kind", F.lit(True).alias("known"))
    rows = table(spark, d, "readings").join(now, "unit_id", "left")
    allowed = (F.col("status").isin("read", "gap") & (F.col("stage") == "initial")) | (F.col("status").isin("deep_read", "gap") & (F.col("stage") == "deep"))
    rules = {
        "stage": ~F.col("stage").isin("initial", "deep"),
        "status": ~allowed,
        "notes": F.coalesce(F.trim("notes"), F.lit("")) == "",
        "unit": F.col("known").isNull() | F.coalesce("retired", F.lit(False)) | ~F.coalesce("required", F.lit(False)),
        "blocked": (F.col("kind") == "gap") & (F.col("status") != "gap"),
    }
    return kn.violations(rows, F.concat_ws(" ", "unit_id", "stage", F.col("run_no").cast("string"), F.col("attempt").cast("string")), rules)


@query(f"with {LATEST} select distinct unit_id, run_no from readings where unit_id not in (select unit_id from latest where not coalesce(retired, false))")
def dangling_relations(spark: SparkSession, d: str) -> DataFrame:
    """Runs that refer to units which aren't live."""
    live = units(spark, d).where(~F.coalesce("retired", F.lit(False)))
    return it.missing(table(spark, d, "readings").select("unit_id", "run_no").distinct(), live, ["unit_id"])


# -- evolution: the units as of the last successful run, and as they are now

MARK = "mark as (select max(revision) as until_revision from state_runs where status = 'succeeded')"
BEFORE = f"""{LATEST}, {MARK}, live as (select * from latest where not coalesce(retired, false)),
before as (select * from (select *, row_number() over (partition by unit_id order by revision desc, arrived_at desc, coalesce(fingerprint, '') desc, kind desc, owner_id desc) as j from units, mark where revision <= until_revision) v where j = 1 and not coalesce(retired, false)),
delta as (select coalesce(b.unit_id, a.unit_id) as unit_id, coalesce(a.owner_id, b.owner_id) as owner_id, case when b.unit_id is null then 'added' when a.unit_id is null then 'removed' else 'changed' end as change
  from before b full outer join live a on a.unit_id = b.unit_id where a.unit_id is null or b.unit_id is null or a.fingerprint is distinct from b.fingerprint)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Live units as of the last successful run's revision, and now."""
    mark = table(spark, d, "state_runs").where("status = 'succeeded'").agg(F.max("revision").alias("until_revision"))
    rows = table(spark, d, "units").select("unit_id", "revision", "arrived_at", "fingerprint", "kind", "owner_id", "retired")
    before = un.latest_units(rows.crossJoin(F.broadcast(mark)).where("revision <= until_revision").drop("until_revision"))  # mark: one row
    live = ~F.coalesce("retired", F.lit(False))
    return before.where(live), un.latest_units(rows).where(live)


def changed_units(spark: SparkSession, d: str) -> DataFrame:
    before, now = snapshots(spark, d)
    owners = now.select("unit_id", "owner_id").unionByName(before.select("unit_id", "owner_id")).groupBy("unit_id").agg(F.max("owner_id").alias("owner_id"))
    return it.diff(before, now, "unit_id", "fingerprint").join(owners, "unit_id")


@query(f"with {BEFORE} select unit_id, change from delta")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Units added, removed and changed since the last successful run."""
    before, now = snapshots(spark, d)
    return it.diff(before, now, "unit_id", "fingerprint")


@query(f"with {BEFORE} select distinct owner_id from delta")
def affected_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of changed units."""
    return changed_units(spark, d).select("owner_id").distinct()


@query(f"with {BEFORE} select distinct entry_id from index_entries where entry_type = 'knowledge' and source_id in (select owner_id from delta)")
def affected_records(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge on sources with changed units."""
    owners = changed_units(spark, d).select(F.col("owner_id").alias("source_id")).distinct()
    return table(spark, d, "index_entries").where("entry_type = 'knowledge'").join(owners, "source_id", "left_semi").select("entry_id").distinct()


@query(f"with {BEFORE}, {READS} select unit_id, run_no from reads where stage = 'deep' and unit_id in (select unit_id from delta)")
def affected_reads(spark: SparkSession, d: str) -> DataFrame:
    """Deep readings of changed units."""
    return readings(spark, d).where("stage = 'deep'").join(changed_units(spark, d), "unit_id", "left_semi").select("unit_id", "run_no")


@query(f"""with {BEFORE}, pairs as (select coalesce(b.owner_id, a.owner_id) as owner_id, b.unit_id is not null as was, a.unit_id is not null as now, b.unit_id is null or a.unit_id is null or a.fingerprint is distinct from b.fingerprint as differs
  from before b full outer join live a on a.unit_id = b.unit_id and a.owner_id = b.owner_id)
select owner_id, case when not bool_or(was) then 'added' when not bool_or(now) then 'removed' else 'changed' end as change from pairs group by 1 having bool_or(differs)""")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    """Owners whose inventory differs between the snapshots in any of its units."""
    before, now = snapshots(spark, d)
    return it.inventory_diff(before, now, "owner_id", "unit_id", "fingerprint")


@query(f"with {BEFORE} select (select count(*) from delta where change = 'added') as added, (select count(*) from delta where change = 'changed') as changed, (select count(*) from delta where change = 'removed') as removed, (select count(distinct owner_id) from delta) as owners")
def enrichment_event(spark: SparkSession, d: str) -> DataFrame:
    """What an update event would say, one row."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changed_units(spark, d).agg(count("added"), count("changed"), count("removed"), F.count_distinct("owner_id").alias("owners"))


@query(f"with {BEFORE}, {READS} select r.unit_id, r.stage, case when l.unit_id is null then 'dropped' when l.fingerprint = r.unit_fingerprint then 'kept' else 'needs_revalidation' end as carried from reads r left join live l on l.unit_id = r.unit_id")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Readings taken over to the units as they are now."""
    now = snapshots(spark, d)[1].select("unit_id", "fingerprint", F.lit(True).alias("known"))
    carried = F.when(F.col("known").isNull(), "dropped").when(F.col("fingerprint") == F.col("unit_fingerprint"), "kept").otherwise("needs_revalidation")
    return readings(spark, d).join(now, "unit_id", "left").select("unit_id", "stage", carried.alias("carried"))


@query(f"with {BEFORE} select unit_id, revision, retired is true as retired, k > 1 as superseded from (select *, dense_rank() over (partition by unit_id order by revision desc) as k from (select distinct unit_id, revision, bool_or(coalesce(retired, false)) over (partition by unit_id, revision) as retired from units) u) v")
def unit_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Versions of units, with whether a later one replaces them."""
    rows = table(spark, d, "units").groupBy("unit_id", "revision").agg(F.bool_or(F.coalesce("retired", F.lit(False))).alias("retired"))
    top = rows.groupBy("unit_id").agg(F.max("revision").alias("top"))
    return rows.join(top, "unit_id").select("unit_id", "revision", "retired", (F.col("revision") < F.col("top")).alias("superseded"))


@query(f"with {BEFORE} select b.unit_id, b.fingerprint from before b where not exists (select 1 from live l where l.unit_id = b.unit_id and l.fingerprint = b.fingerprint)")
def preserve_check(spark: SparkSession, d: str) -> DataFrame:
    """Units of the earlier snapshot that the later one doesn't hold unchanged."""
    before, now = snapshots(spark, d)
    return it.missing(before.select("unit_id", "fingerprint"), now, ["unit_id", "fingerprint"])


@query(f"with {COVERED}, r1 as (select unit_id, status from covered where stage = 'initial'), r2 as (select unit_id, status from covered where stage = 'deep') select l.unit_id, l.revision, coalesce(l.retired, false) as retired, r1.status as initial_status, r2.status as deep_status from latest l left join r1 on r1.unit_id = l.unit_id left join r2 on r2.unit_id = l.unit_id")
def replay_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after the whole journal: every unit with its version and the status of both stages."""
    by_stage = covered(spark, d).groupBy("unit_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("status"))).alias(f"{s}_status") for s in STAGES])
    return units(spark, d).select("unit_id", "revision", F.coalesce("retired", F.lit(False)).alias("retired")).join(by_stage, "unit_id", "left")


# -- integrity


@query("select unit_id, 'left' as side from (select distinct unit_id from units) u where unit_id not in (select entry_id from index_entries where entry_type = 'unit') union all select entry_id, 'right' from (select distinct entry_id from index_entries where entry_type = 'unit') e where entry_id not in (select unit_id from units)")
def member_symdiff(spark: SparkSession, d: str) -> DataFrame:
    """Units without an entry, and entries without a unit."""
    entries = table(spark, d, "index_entries").where("entry_type = 'unit'").select(F.col("entry_id").alias("unit_id"))
    return it.symmetric_difference(table(spark, d, "units"), entries, "unit_id")


@query("select distinct unit_id, stage from readings where unit_id not in (select entry_id from index_entries)")
def unresolved_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose unit no entry refers back to."""
    entries = table(spark, d, "index_entries").select(F.col("entry_id").alias("unit_id"))
    return it.missing(table(spark, d, "readings").select("unit_id", "stage").distinct(), entries, ["unit_id"])


@query("select distinct l_orderkey, l_linestatus from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = l_linestatus)")
def crop_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose whole is missing or in another state."""
    whole = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return it.missing(table(spark, d, "lineitem").select("l_orderkey", "l_linestatus").distinct(), whole, ["l_orderkey", "l_linestatus"])


@query("select l_partkey, count(distinct l_orderkey) as origins, count(*) as occurrences from lineitem group by 1")
def asset_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each asset once, with its origins and all occurrences."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("origins"), F.count("*").alias("occurrences"))


@query("select unit_id, stage, last.status as severity from (select unit_id, stage, max({'noted_at': noted_at, 'run_no': run_no, 'attempt': attempt, 'status': status}) as last from readings group by 1, 2) x")
def issue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Issues by subject and reason, the last one of each."""
    return kn.latest(table(spark, d, "readings"), ["unit_id", "stage"], ["noted_at", "run_no", "attempt"], ["status"]).select("unit_id", "stage", F.col("status").alias("severity"))


@query("""select l_orderkey, l_linenumber, l_discount * 10 as x, l_quantity / 50 as width, l_discount * 10 >= 0 and l_quantity / 50 > 0 and l_discount * 10 + l_quantity / 50 <= 1.2 and l_tax * 10 + 0.3 <= 1 as valid from (select distinct l_orderkey, l_linenumber, l_discount, l_quantity, l_tax from lineitem) l""")
def bbox_valid(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in the frame of their parent."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax").distinct()
    x, width = F.col("l_discount") * 10, F.col("l_quantity") / 50
    ok = it.inside(x, F.col("l_tax") * 10, width, F.lit(0.3), F.lit(1.2), F.lit(1.0))
    return rows.select("l_orderkey", "l_linenumber", x.alias("x"), width.alias("width"), ok.alias("valid"))


@query("""with r as (select l_orderkey, (l_linenumber - 1) * 10 as s, (l_linenumber - 1) * 10 + l_quantity as e, max(l_linenumber) over (partition by l_orderkey) * 10 as len from lineitem),
g as (select *, s > coalesce(max(e) over (partition by l_orderkey order by s, e rows between unbounded preceding and 1 preceding), 0) as gap from r) select l_orderkey, not bool_or(gap) and max(e) >= max(len) as covered from g group by 1""")
def range_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was shown covers the whole."""
    rows = table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_linenumber") - 1) * 10).alias("s"), ((F.col("l_linenumber") - 1) * 10 + F.col("l_quantity")).alias("e"), "l_linenumber")
    size = rows.groupBy("l_orderkey").agg((F.max("l_linenumber") * 10).alias("len"))
    return it.range_coverage(rows.join(size, "l_orderkey"), "l_orderkey", "s", "e", "len")


@query(f"""with {sq.LINES}, cut as (select doc_id, line_no, length(line)::int as len, unnest(c) as clause, generate_subscripts(c, 1) as i from (select doc_id, line_no, line, {sq.clauses('line')} as c from lines) x),
 placed as (select *, coalesce(sum(length(clause)) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0)::int as s from cut),
 kept as (select *, s + length(clause)::int as e from placed where not regexp_matches(clause, '^{sq.SPACE}*$')), f as (select *, s = coalesce(lag(e) over (partition by doc_id, line_no order by s), 0) and e > s as fits from kept)
 select doc_id, line_no, bool_and(fits) and max(e) = max(len) as exact from f group by 1, 2""")
def replacement_spans(spark: SparkSession, d: str) -> DataFrame:
    """Whether the clauses of a line part it exactly."""
    rows = un.text_lines(table(spark, d, "documents"))
    spans = rows.select("doc_id", "line_no", F.length("line").alias("len"), F.inline(tx.clauses(F.col("line"))))
    return it.contiguous(spans, ["doc_id", "line_no"], "start", "end", "len")


@query(f"with {LATEST} select r.unit_id, r.run_no, r.attempt, case when l.unit_id is null then 'unknown' when coalesce(l.retired, false) then 'retired' when l.fingerprint is distinct from r.unit_fingerprint then 'changed' else 'valid' end as receipt from (select distinct unit_id, run_no, attempt, unit_fingerprint from readings) r left join latest l on l.unit_id = r.unit_id")
def receipt_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether receipts still hold."""
    now = units(spark, d).select("unit_id", "fingerprint", "retired", F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "unknown").when(F.coalesce("retired", F.lit(False)), "retired").when(~F.col("fingerprint").eqNullSafe(F.col("unit_fingerprint")), "changed").otherwise("valid")
    rows = table(spark, d, "readings").select("unit_id", "run_no", "attempt", "unit_fingerprint").distinct()
    return rows.join(now, "unit_id", "left").select("unit_id", "run_no", "attempt", state.alias("receipt"))


@query("select name, row_number() over (order by name like '%list%', name, source_id) as place from (select distinct name, source_id from sources) s")
def publish_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of publication: lists (the manifests) last."""
    rows = table(spark, d, "sources").select("name", "source_id", F.col("name").contains("list").alias("last")).distinct()
    return un.numbered(rows, ["last", "name", "source_id"]).select("name", F.col("n").alias("place"))


@query("""select distinct entry_id, source_id from index_entries where entry_type = 'knowledge' and coalesce(trim(name), '') <> '' and coalesce(trim(body), '') <> '' and review_status in ('source_checked', 'human_reviewed') and source_id in (select source_id from sources)""")
def legacy_record(spark: SparkSession, d: str) -> DataFrame:
    """Records that pass all conditions for being taken over."""
    rows = table(spark, d, "index_entries").where("entry_type = 'knowledge' and coalesce(trim(name), '') <> '' and coalesce(trim(body), '') <> '' and review_status in ('source_checked', 'human_reviewed')")
    return rows.join(table(spark, d, "sources").select("source_id").distinct(), "source_id", "left_semi").select("entry_id", "source_id").distinct()


CHECKS = f"""{JUDGED}, errors as (
 select 'stale reference' as "check", entry_id || ' ' || unit_id as subject from judged where wrong is not null
 union select 'posting without record', term || ' ' || p.entry_no from (select term, unnest(postings) as p from index_shards where term is not null) s where p.entry_no not in (select entry_no from index_entries)
 union select 'reading without entry', unit_id from readings where unit_id not in (select entry_id from index_entries)
 union select 'unit without source', unit_id from units where owner_id not in (select source_id from sources))"""


@query(f'with {CHECKS} select "check", subject from errors')
def verify_errors(spark: SparkSession, d: str) -> DataFrame:
    """What all checks found."""
    owners = table(spark, d, "sources").select(F.col("source_id").alias("owner_id"))
    postings = table(spark, d, "index_shards").where("term is not null").select("term", F.explode("postings.entry_no").alias("entry_no")).where("entry_no is not null").distinct()
    return it.report(
        [
            ("stale reference", judged(spark, d).where("wrong is not null").select(F.concat_ws(" ", "entry_id", "unit_id").alias("subject"))),
            ("posting without record", it.missing(postings, table(spark, d, "index_entries"), ["entry_no"]).select(F.concat_ws(" ", "term", F.col("entry_no").cast("string")).alias("subject"))),
            ("reading without entry", unresolved_occurrences(spark, d).select(F.col("unit_id").alias("subject"))),
            ("unit without source", it.missing(table(spark, d, "units").select("unit_id", "owner_id").distinct(), owners, ["owner_id"]).select(F.col("unit_id").alias("subject"))),
        ]
    )


@query(f'with {CHECKS} select "check", count(*) as n from errors group by 1')
def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    """How much each check found."""
    return verify_errors(spark, d).groupBy("check").agg(F.count("*").alias("n"))
