"""Queries on the journal folded into its state, and on the index and graph made from that.

Bindings: a version of a unit defines it, a retired one retires it; readings of attempts that succeeded are
noted at the revision that their run read, those of failed attempts call for another reading; knowledge
entries are records, which rest on the units of their source with their text as first defined, and depend on
the first term or overview of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import graph as gr
from lectern.operators import index as ix
from lectern.operators import projection as pr
from lectern.plans import sqltext as sq
from lectern.session import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
STAGES = ["initial", "deep"]
TERM = "page image"
#: What a record of a kind depends on: the first record of this kind of its source.
DEPENDS = {"rule": "term", "term": "overview"}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge records, each once."""
    rows = table(spark, d, "index_entries").where("entry_type = 'knowledge' and entry_id is not null")
    columns = [F.col("entry_id").alias("id"), F.col("entry_no").alias("revision"), F.lit(1).alias("version"), "kind", "source_id", "name", F.col("section").alias("scope"), "body", "review_status"]
    return rows.select(*columns).distinct()


def firsts(records: DataFrame, kind: str) -> DataFrame:
    """(source_id, on): the first record of a kind of each source."""
    return records.where((F.col("kind") == kind) & F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min("id").alias("on"))


def attempts(spark: SparkSession, d: str, status: str) -> DataFrame:
    """(run_no, attempt, revision) of attempts; the table is of a fixed size."""
    return F.broadcast(table(spark, d, "state_runs").where(F.col("status") == status).groupBy("run_no", "attempt").agg(F.max("revision").alias("revision")))


def events(spark: SparkSession, d: str) -> pr.Events:
    units = table(spark, d, "units").where("unit_id is not null")
    live = ~F.coalesce("retired", F.lit(False))
    definitions = units.where(live & F.col("fingerprint").isNotNull()).select("unit_id", "revision", "fingerprint", "kind", "owner_id", "required", "text", "section_path", F.col("locator.part").alias("part"), F.col("locator.paragraph").alias("paragraph"))
    records = materialize(knowledge(spark, d), "records")
    first = definitions.groupBy("unit_id").agg(F.min(F.struct("revision", "fingerprint", "owner_id", "text")).alias("first"))
    first = first.select("unit_id", F.col("first.fingerprint").alias("unit_fingerprint"), F.col("first.owner_id").alias("source_id"), F.col("first.text").alias("body"))
    evidence = records.where("body <> ''").select("id", "source_id", "body").join(first.where("body <> ''"), ["source_id", "body"]).select("id", "unit_id", "unit_fingerprint").distinct()
    known = table(spark, d, "sources").select("source_id", F.lit(True).alias("held")).distinct()
    sources = records.where("source_id is not null").select("id", "source_id").join(known, "source_id", "left").select("id", "source_id", F.coalesce("held", F.lit(False)).alias("held"))
    depends = None
    for kind, on in DEPENDS.items():
        part = records.where(F.col("kind") == kind).select("id", "source_id").join(firsts(records, on), "source_id").select("id", "on", F.lit(1).alias("version"))
        depends = part if depends is None else depends.unionByName(part)
    reads = table(spark, d, "readings")
    noted = reads.join(attempts(spark, d, "succeeded"), ["run_no", "attempt"]).select("unit_id", "stage", "revision", "unit_fingerprint", "status")
    again = reads.join(attempts(spark, d, "failed"), ["run_no", "attempt"]).select("unit_id", "stage", "revision").distinct()
    owners = definitions.where("required").select("unit_id", F.col("owner_id").alias("source_id")).distinct()
    bound = owners.join(firsts(records, "overview"), "source_id").select("unit_id", F.lit("deep").alias("stage"), "on", F.lit(1).alias("version")).distinct()
    rechecks = records.where("review_status is null").select("id", "version", F.lit("review pending").alias("reason"))
    return pr.Events(definitions, units.where(~live).select("unit_id", "revision"), records, noted, again, evidence, sources, depends, rechecks, bound)


def state(spark: SparkSession, d: str) -> pr.State:
    return pr.replay(events(spark, d), STAGES, F.col("kind") == "gap")


FOLD = """defs as (select unit_id, revision, fingerprint, kind, owner_id, required, text, section_path, locator.part as part, locator.paragraph as paragraph from units where unit_id is not null and fingerprint is not null and not coalesce(retired, false)),
 gone as (select unit_id, max(revision) as gone from units where retired and unit_id is not null group by 1),
 ru as (select d.*, coalesce(g.gone > d.revision, false) as retired from (select *, row_number() over (partition by unit_id order by revision desc, fingerprint desc, kind desc, owner_id desc, required desc, text desc, section_path desc, part desc, paragraph desc) as k from defs) d left join gone g on g.unit_id = d.unit_id where k = 1),
 rec as (select distinct entry_id as id, kind, source_id, name, section as scope, body, review_status from index_entries where entry_type = 'knowledge' and entry_id is not null),
 ff as (select unit_id, fingerprint, owner_id, text from (select *, row_number() over (partition by unit_id order by revision, fingerprint, owner_id, text nulls first) as k from defs) x where k = 1),
 ev as (select distinct r.id, f.unit_id, f.fingerprint from rec r join ff f on f.owner_id = r.source_id and f.text = r.body where r.body <> ''),
 firsts as (select source_id, kind, min(id) as "on" from rec where source_id is not null group by 1, 2),
 deps as (select r.id, f."on" from rec r join firsts f on f.source_id = r.source_id and (r.kind = 'rule' and f.kind = 'term' or r.kind = 'term' and f.kind = 'overview')),
 seeds as (select e.id, 'unit changed or missing: ' || e.unit_id as reason from ev e left join ru on ru.unit_id = e.unit_id and not ru.retired where ru.fingerprint is distinct from e.fingerprint
   union select id, 'source changed or missing: ' || source_id from rec where source_id is not null and source_id not in (select source_id from sources) union select id, 'review pending' from rec where review_status is null),
 stale as (select id, reason from seeds union select d.id, 'depends on ' || d."on" from stale s join deps d on d."on" = s.id)"""
READ = """att as (select run_no, attempt, status, max(revision) as revision from state_runs group by 1, 2, 3),
 lr as (select * from (select *, row_number() over (partition by unit_id, stage order by revision desc, unit_fingerprint desc, status desc) as k from (select r.unit_id, r.stage, a.revision, r.unit_fingerprint, r.status from readings r join att a on a.run_no = r.run_no and a.attempt = r.attempt and a.status = 'succeeded' where r.unit_id is not null and r.stage is not null) x) y where k = 1),
 asked as (select r.unit_id, r.stage, max(a.revision) as asked from readings r join att a on a.run_no = r.run_no and a.attempt = r.attempt and a.status = 'failed' group by 1, 2),
 bound as (select distinct d.unit_id, f."on" from defs d join firsts f on f.source_id = d.owner_id and f.kind = 'overview' where d.required and f."on" in (select id from stale)),
 unsound as (select unit_id, 'deep' as stage, string_agg('bound knowledge: ' || "on", '; ' order by "on") as why from bound group by 1),
 cov as (select u.unit_id, s.stage, r.unit_fingerprint = u.fingerprint as fresh, r.status, r.unit_id is not null as was_read, u.kind = 'gap' as blocked,
   nullif(concat_ws('; ', case when a.asked >= r.revision then 'called for again' end, w.why), '') as why
  from ru u cross join (select unnest(['initial', 'deep']) as stage) s left join lr r on r.unit_id = u.unit_id and r.stage = s.stage left join asked a on a.unit_id = u.unit_id and a.stage = s.stage left join unsound w on w.unit_id = u.unit_id and w.stage = s.stage where u.required and not u.retired)"""


@query(f"with recursive {FOLD} select unit_id, revision, fingerprint, kind, owner_id, required, retired from ru")
def replay_units(spark: SparkSession, d: str) -> DataFrame:
    """Units after all definitions and retirements."""
    e = events(spark, d)
    return pr.units_now(e.definitions, e.retirements).select("unit_id", "revision", "fingerprint", "kind", "owner_id", "required", "retired")


@query(f"with recursive {FOLD} select id, reason from stale")
def replay_stale(spark: SparkSession, d: str) -> DataFrame:
    """Records that don't hold any more, with all reasons."""
    return state(spark, d).stale


@query(f"with recursive {FOLD}, {READ} select unit_id, stage, case when fresh and why is not null then 'needs_revalidation' when fresh then status when blocked then 'gap' when was_read then 'needs_revalidation' else 'unread' end as status, case when fresh then why end as reasons from cov")
def replay_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The status of every required unit and stage, with rechecks and bound knowledge."""
    return state(spark, d).coverage


def documents(s: pr.State) -> DataFrame:
    """Documents of the index from a state."""
    unknown = F.array_compact(F.array(F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "no content"), F.when(F.coalesce(F.trim("scope"), F.lit("")) == "", "no scope")))
    units = s.units.select("unit_id", "kind", F.array("owner_id").alias("source_ids"), "text", F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), F.col("part").alias("metadata"), F.struct("part", "paragraph").alias("locator"), "retired")
    records = s.records.withColumn("unknowns", unknown).withColumn("source_ids", F.array_compact(F.array("source_id")))
    return gr.index_documents(units, records, s.stale)


def edges(spark: SparkSession, d: str, s: pr.State) -> DataFrame:
    """The graph of a state: clauses in their paragraph, records on their units, rules on their term."""
    live = s.units.where("not retired")
    whole = live.where("kind = 'paragraph' and paragraph is not null").groupBy("owner_id", "part", "paragraph").agg(F.min("unit_id").alias("parent_id"))
    clause = live.where("kind = 'clause'").select("unit_id", F.col("owner_id").alias("o"), F.col("part").alias("p"), F.col("paragraph").alias("g"))
    parents = clause.join(whole, F.col("o").eqNullSafe(F.col("owner_id")) & F.col("p").eqNullSafe(F.col("part")) & (F.col("g") == F.col("paragraph"))).select("unit_id", "parent_id")
    e = events(spark, d)
    gone = s.stale.select("id").distinct()
    relations = e.depends.select("id", F.col("on").alias("target_id"), F.lit("uses").alias("kind"))
    return gr.graph(parents, e.evidence.join(gone, "id", "left_anti"), relations.join(gone, "id", "left_anti"))


DOCS = f"""{FOLD}, docs as (select unit_id as id, 'unit' as type, kind, '' as name, coalesce(text, '') as body, coalesce(array_to_string(section_path, ' > '), '') as section, coalesce(part, '') as metadata, null::varchar as review_status from ru where not retired
 union all select id, 'knowledge', kind, coalesce(name, ''), coalesce(body, ''), coalesce(scope, ''), concat_ws(' ', case when coalesce(trim(body), '') = '' then 'no content' end, case when coalesce(trim(scope), '') = '' then 'no scope' end), review_status from rec where id not in (select id from stale))"""
EDGES = """whole as (select owner_id, part, paragraph, min(unit_id) as parent_id from ru where not retired and kind = 'paragraph' and paragraph is not null group by 1, 2, 3),
 one as (select c.unit_id as a, w.parent_id as b, 'paragraph_context' as reason from ru c join whole w on w.owner_id is not distinct from c.owner_id and w.part is not distinct from c.part and w.paragraph = c.paragraph where c.kind = 'clause' and not c.retired
   union select id, unit_id, 'claim_evidence' from ev where id not in (select id from stale) union select id, "on", 'knowledge_relation:uses' from deps where id not in (select id from stale)),
 edges as (select a, b, reason from one where a <> b union select b, a, reason from one where a <> b)"""


@query(f"with recursive {DOCS} select id, type, kind, name, body, section, metadata, review_status from docs")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is searched: live units and records that hold."""
    return documents(state(spark, d)).select("id", "type", "kind", "name", "body", "section", "metadata", "review_status")


@query(f"with recursive {FOLD}, {EDGES} select a, b, reason from edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All relationships, both ways."""
    return edges(spark, d, state(spark, d))


_TOKENS = " union all ".join(f"select id, '{f}' as field, unnest({sq.tokens(f)}) as term from docs" for f in ("name", "body", "section", "metadata"))


@query(f"""with recursive {DOCS}, {EDGES}, toks as ({_TOKENS}), wanted as (select distinct unnest({sq.tokens(repr(TERM), False)}) as term),
 tf as (select id, field, k.term, count(*) as tf from toks k join wanted w on w.term = k.term group by 1, 2, 3), df as (select term, count(distinct id) as df from tf group by 1),
 sc as (select id, sum(case field when 'name' then 4.0 when 'body' then 2.0 when 'section' then 1.5 else 0.5 end * ln(1 + ((select count(*) from docs) + 1) / (d.df + 1)) * (1 + ln(tf))) as score, array_to_string(list_sort(list(distinct t.term || ':' || field)), ' ') as matches from tf t join df d on d.term = t.term group by 1),
 su as (select s.id, s.score + case when contains({sq.normal('d.name')}, {sq.normal(f"'{TERM}'")}) or contains({sq.normal('d.body')}, {sq.normal(f"'{TERM}'")}) then 5 else 0 end as score, matches from sc s join docs d on d.id = s.id),
 near as (select e.b as id, max(s.score * 0.25) as score, '' as matches from su s join edges e on e.a = s.id where e.b in (select id from docs) and e.b not in (select id from su) group by 1)
 select r.id, round(score, 5) as score, matches, type, kind, section, body[:500] as snippet, length(body) > 500 as snippet_truncated from (select * from su union all select * from near) r join docs d on d.id = r.id""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """A search over the state's documents with one hop along the graph; what a result shows."""
    s = state(spark, d)
    docs = materialize(documents(s), "docs")
    found = ix.search(docs, TERM, fields=("name", "body", "section", "metadata"), edges=edges(spark, d, s))
    return ix.hits(found, docs).select("id", "score", F.array_join("matches", " ").alias("matches"), "type", "kind", "section", "snippet", "snippet_truncated")
