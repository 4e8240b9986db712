"""Queries on sources, documents and reading units, each with comparison SQL where SQL can say it.

Bindings of relations to tables are kept here, so that operators know nothing of them: a document is a
Markdown source, a row of ``units`` a version of a reading unit, a row of ``sources`` a captured file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import index as ix
from lectern.operators import units as un
from lectern.plans import sqltext as sq
from lectern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources")


def units(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Current versions of units, without their texts unless asked for: what is kept per unit is shuffled whole."""
    return un.latest_units(table(spark, d, "units").select("unit_id", "revision", "arrived_at", "fingerprint", "kind", "owner_id", "locator", "required", "retired", "section_path", *more))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return un.text_lines(documents(spark, d))


#: latest(...): current versions of units, as ``units`` above.
LATEST = """latest as (
  select * from (select *, row_number() over (partition by unit_id order by revision desc, arrived_at desc, coalesce(fingerprint, '') desc, kind desc, owner_id desc) as k from units) v where k = 1)"""
#: paragraphs(...): one row per paragraph of a source; repeated rows of a source once.
PARAGRAPHS = """paragraphs as (
  select distinct source_id, name, p.id as para_id, p.line_start as line_no, p.text as text, p.heading_level as heading_level, p.kind as kind, array_to_string(p.section_path, ' > ') as path
  from (select source_id, name, unnest(structure.paragraphs) as p from sources) s)"""


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d).select("source_id", "name", F.explode("structure.paragraphs").alias("p"))
    return rows.select("source_id", "name", F.col("p.id").alias("para_id"), F.col("p.line_start").alias("line_no"), F.col("p.text").alias("text"), F.col("p.heading_level").alias("heading_level"), F.col("p.kind").alias("kind"), F.array_join("p.section_path", " > ").alias("path")).distinct()


@query("select source_id, name, kind, status, max(byte_count) as byte_count from sources group by source_id, name, kind, status")
def scan_sources(spark: SparkSession, d: str) -> DataFrame:
    """Captured files, each once, in name order."""
    return sources(spark, d).groupBy("source_id", "name", "kind", "status").agg(F.max("byte_count").alias("byte_count")).orderBy("name", "source_id")


@query("""
select source_id, name, case lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1))
  when 'docx' then 'docx' when 'pdf' then 'pdf' when 'xlsx' then 'xlsx' when 'vsdx' then 'vsdx' when 'txt' then 'text' when 'text' then 'text' when 'log' then 'text'
  when 'md' then 'markdown' when 'markdown' then 'markdown' when 'csv' then 'csv' when 'tsv' then 'csv' when 'emf' then 'emf' when 'wmf' then 'emf' when 'svg' then 'svg'
  when 'png' then 'image' when 'jpg' then 'image' when 'jpeg' then 'image' when 'gif' then 'image' when 'bmp' then 'image' when 'tif' then 'image' when 'tiff' then 'image' when 'webp' then 'image'
  else 'unsupported' end as by_suffix
from sources group by source_id, name""")
def kind_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The reader that a file name asks for."""
    return sources(spark, d).select("source_id", "name").distinct().withColumn("by_suffix", tx.file_kind(F.col("name")))


@query(f"with {sq.LINES} select doc_id, line_no, 'L' || lpad(line_no::varchar, 6, '0') as line_id, line from lines")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents."""
    return lines(spark, d)


@query(f"""with {PARAGRAPHS}, links as (select source_id, line_no, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as target from paragraphs)
select source_id, line_no, target from links""")
def visual_links(spark: SparkSession, d: str) -> DataFrame:
    """Image links of paragraphs."""
    found = paragraphs(spark, d).select("source_id", "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)).alias("target"))
    return found




@query(f"""with {PARAGRAPHS}, links as (select distinct source_id, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as target from paragraphs),
  files as (select lower(name) as name, min(source_id) as linked from sources group by 1)
select l.source_id, l.target, f.linked, case when regexp_matches(l.target, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'remote' when f.linked is not null then 'resolved_to_selected_input' else 'reference_only_not_fetched' end as status
from links l left join files f on lower(regexp_replace(l.target, '^.*/', '')) = f.name""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Link targets, each with the captured file of that name, if there is one."""
    links = visual_links(spark, d).select("source_id", "target").distinct()
    files = sources(spark, d).groupBy(F.lower("name").alias("base")).agg(F.min("source_id").alias("linked"))
    joined = links.withColumn("base", F.lower(F.regexp_replace("target", r"^.*/", ""))).join(files, "base", "left")
    status = F.when(F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "remote").when(F.col("linked").isNotNull(), "resolved_to_selected_input").otherwise("reference_only_not_fetched")
    return joined.select("source_id", "target", "linked", status.alias("status"))


@query(f"""with {PARAGRAPHS}, links as (select distinct source_id, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as target from paragraphs)
select source_id, target, case when regexp_matches(target, '(^|/)\\.\\.(/|$)|^/') then 'escapes' else 'missing' end as problem from links
where not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') and (regexp_matches(target, '(^|/)\\.\\.(/|$)|^/') or lower(regexp_replace(target, '^.*/', '')) not in (select lower(name) from sources where name is not null))""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Local link targets that leave the package or name no file of it."""
    outside = F.col("target").rlike(r"(^|/)\.\.(/|$)|^/")
    return link_resolution(spark, d).where((F.col("status") != "remote") & (outside | F.col("linked").isNull())).select("source_id", "target", F.when(outside, "escapes").otherwise("missing").alias("problem"))


@query(f"""with {sq.LINES}, cut as (select doc_id, line_no, unnest(c) as clause, generate_subscripts(c, 1) as i from (select doc_id, line_no, {sq.clauses('line')} as c from lines) x),
 placed as (select *, coalesce(sum(length(clause)) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0)::int as s from cut)
select doc_id, line_no, s as "start", s + length(clause)::int as "end", clause from placed where not regexp_matches(clause, '^{sq.SPACE}*$')""")
def clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of all lines, with offsets."""
    return un.line_clauses(lines(spark, d))


@query(f"""with {sq.LINES} select doc_id, line_no, (sum(case when regexp_matches(line, '^\\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by line_no) % 2) = 1 as in_fence from lines""")
def fence_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether each line is in a fence; the opening marker is, the closing one isn't."""
    return un.folded_lines(documents(spark, d)).select("doc_id", "line_no", (F.col("kind") == "code").alias("in_fence"))


@query(f"""with recursive {sq.LINES}, fenced as (select *, (sum(case when regexp_matches(line, '^\\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by line_no) % 2) = 1 as f from lines),
heads as (select doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) as lvl, regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1) as title, row_number() over (partition by doc_id order by line_no) as n
  from fenced where not f and regexp_matches(line, '^#{{1,6}}\\s+.+$')),
walk as (select doc_id, n, line_no, lvl, [title] as path from heads where n = 1
  union all select h.doc_id, h.n, h.line_no, h.lvl, list_append(w.path[:h.lvl - 1], h.title) from walk w join heads h on h.doc_id = w.doc_id and h.n = w.n + 1)
select doc_id, line_no, lvl::int as heading_level, array_to_string(path, ' > ') as section_path from walk""")
def section_path(spark: SparkSession, d: str) -> DataFrame:
    """The section path of each heading; levels that are skipped leave no gap."""
    rows = un.folded_lines(documents(spark, d)).where("heading_level is not null")
    return rows.select("doc_id", "line_no", "heading_level", F.array_join("section_path", " > ").alias("section_path"))


@query(f"with {PARAGRAPHS} select source_id, para_id, line_no, text as title, heading_level, path from paragraphs where heading_level is not null")
def navigation(spark: SparkSession, d: str) -> DataFrame:
    """Headings of sources with their paths."""
    return paragraphs(spark, d).where("heading_level is not null").select("source_id", "para_id", "line_no", F.col("text").alias("title"), "heading_level", "path")


@query(f"""with {sq.LINES}, near as (
  select doc_id, line_no, list(case when not regexp_matches(line, '^{sq.SPACE}*$') then line[:1500] end) over (partition by doc_id order by line_no rows between 3 preceding and 3 following) as l from lines)
select doc_id, line_no, array_to_string(list_filter(l, lambda x: x is not null), chr(10)) as nearby from near""")
def nearby_text(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines around each line."""
    return un.nearby_text(lines(spark, d)).select("doc_id", "line_no", F.array_join("nearby", "\n").alias("nearby"))


@query(f"""with {LATEST} select unit_id, array_to_string(list_concat(
   list(unit_id) over (partition by owner_id order by locator.paragraph, unit_id rows between 2 preceding and 1 preceding),
   list(unit_id) over (partition by owner_id order by locator.paragraph, unit_id rows between 1 following and 2 following)), ' ') as neighbours from latest""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Units at most two places before and after a unit of the same owner."""
    rows = units(spark, d).select("unit_id", "owner_id", F.col("locator.paragraph").alias("paragraph"))
    return un.neighbours(rows, "owner_id", ["paragraph", "unit_id"], "unit_id").select("unit_id", F.array_join("neighbours", " ").alias("neighbours"))


def document_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph and clause units of documents; the owner is the id of the content."""
    docs = documents(spark, d).where("text is not null").withColumn("owner_id", tx.content_id("S", F.col("text")))
    rows = un.folded_lines(docs, carry=("owner_id",))
    return un.unit_rows(rows, F.col("owner_id"), F.concat(F.lit("d"), F.col("doc_id")))


_UNITS = f"""{sq.LINES}, owners as (select doc_id, 'S' || substr(sha256(text), 1, 24) as owner_id from documents where text is not null),
fenced as (select l.*, o.owner_id, 'd' || l.doc_id as part, 'L' || lpad(l.line_no::varchar, 6, '0') as paragraph,
  (sum(case when regexp_matches(line, '^\\s*(```|~~~)') then 1 else 0 end) over (partition by l.doc_id order by line_no) % 2) = 1 as f from lines l join owners o on o.doc_id = l.doc_id),
cut as (select owner_id, part, paragraph, unnest(c) as clause, generate_subscripts(c, 1) as i from (
  select owner_id, part, paragraph, case when f or regexp_matches(line, '^#{{1,6}}\\s+.+$') then [line] else {sq.clauses('line')} end as c from fenced) x),
placed as (select *, coalesce(sum(length(clause)) over (partition by part, paragraph order by i rows between unbounded preceding and 1 preceding), 0)::int as s from cut),
made as materialized (select owner_id, 'paragraph' as kind, part, paragraph, null::int as s, null::int as e, line as text from fenced
  union all select owner_id, 'clause', part, paragraph, s, s + length(clause)::int, clause from placed where not regexp_matches(clause, '^{sq.SPACE}*$'))"""


@query(f"with {_UNITS} select owner_id, kind, part, paragraph, s as \"start\", e as \"end\", text from made")
def create_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of all documents: paragraphs and clauses, headings and code whole."""
    return document_units(spark, d).select("owner_id", "kind", "part", "paragraph", "start", "end", "text")


@query(f"""with {_UNITS} select owner_id, kind, part, paragraph, s as "start", 'U' || substr(sha256('{{"kind":"' || kind || '","locator":{{"end":' || coalesce(e::varchar, 'null') || ',"paragraph":"' || paragraph || '","part":"' || part || '","start":' || coalesce(s::varchar, 'null') || '}},"owner":"' || owner_id || '"}}'), 1, 24) as unit_id from made""")
def unit_ids(spark: SparkSession, d: str) -> DataFrame:
    """Unit ids: a hash of kind, locator and owner in canonical JSON."""
    return document_units(spark, d).select("owner_id", "kind", "part", "paragraph", "start", "unit_id")


@query("""select distinct unit_id, revision, sha256(to_json({'kind': kind, 'locator': case when locator is not null then {'paragraph': locator.paragraph, 'part': locator.part} end, 'owner_id': owner_id, 'required': required, 'retired': retired,
 'section_path': section_path, 'source_ids': source_ids, 'text': text, 'unit_id': unit_id})::varchar) as row_sha256 from units""")
def unit_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A hash of all content of a unit's row in canonical JSON: every column but the fingerprint itself and what
    belongs to the delivery (revision and arrival). Versions that differ in any of it have rows of their own."""
    rows = table(spark, d, "units")
    locator = F.when(F.col("locator").isNotNull(), F.struct("locator.paragraph", "locator.part"))
    fields = [(c, locator if c == "locator" else F.col(c)) for c in rows.columns if c not in ("fingerprint", "revision", "arrived_at")]
    return rows.select("unit_id", "revision", F.sha2(tx.canonical(*fields), 256).alias("row_sha256")).distinct()


@query(f"with {LATEST} select unit_id, kind, owner_id, revision from latest where required and not coalesce(retired, false)")
def required_units(spark: SparkSession, d: str) -> DataFrame:
    """Current units that have to be read."""
    return un.required_units(units(spark, d)).select("unit_id", "kind", "owner_id", "revision")


@query(f"""with {_UNITS} select c.part, c.paragraph, c.s as "start", c.text, p.text as parent_text from made c join made p on p.kind = 'paragraph' and c.part = p.part and c.paragraph = p.paragraph where c.kind = 'clause' and c.text <> p.text""")
def parent_context(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that are a part of their paragraph, with it."""
    rows = document_units(spark, d).select("kind", "part", "paragraph", "start", "text")
    parents = rows.where("kind = 'paragraph'").select("part", "paragraph", F.col("text").alias("parent_text"))
    return rows.where("kind = 'clause'").drop("kind").join(parents, ["part", "paragraph"]).where("text <> parent_text")


@query("select doc_id, text[:500] as snippet, length(text) > 500 as snippet_truncated from documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 characters of each document."""
    return documents(spark, d).select("doc_id", *tx.snippet(F.col("text")))


@query("""select doc_id, substr(text, 101, 600) as shown, length(text)::int as total_chars, case when 700 < length(text) then 700 end as next_text_offset from documents where length(text) >= 100""")
def read_slice(spark: SparkSession, d: str) -> DataFrame:
    """A window of each document from character 100 on."""
    return documents(spark, d).where(F.length("text") >= 100).select("doc_id", *tx.text_slice(F.col("text"), F.lit(100), 600))


@query("""select 'document' as origin, doc_id::varchar as id, text[:2000] as text from documents where lower(text) like '%annex%'
union all select 'unit', unit_id, text[:2000] from units where lower(text) like '%annex%'
union all select 'entry', entry_id, body[:2000] from index_entries where lower(body) like '%annex%'
union all select 'name', entry_id, name from index_entries where lower(name) like '%annex%'
union all select 'note', unit_id, notes[:2000] from readings where lower(notes) like '%annex%'""")
def substring_scan(spark: SparkSession, d: str) -> DataFrame:
    """All texts that contain a word, over five relations."""
    entries = table(spark, d, "index_entries")
    return ix.substring_scan(
        [
            ("document", documents(spark, d).select(F.col("doc_id").alias("id"), "text")),
            ("unit", table(spark, d, "units").select(F.col("unit_id").alias("id"), "text")),
            ("entry", entries.select(F.col("entry_id").alias("id"), F.col("body").alias("text"))),
            ("name", entries.select(F.col("entry_id").alias("id"), F.col("name").alias("text"))),
            ("note", table(spark, d, "readings").select(F.col("unit_id").alias("id"), F.col("notes").alias("text"))),
        ],
        "annex",
    )


@query("""select content, doc_id, names_n from (
  select sha256(text) as content, min(doc_id) as doc_id, count(distinct source) as names_n from documents where text is not null group by 1) x""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the same content: the first one, and the number of labels under which it came."""
    rows = documents(spark, d).where("text is not null").select("doc_id", "source", "text")
    kept = ix.first_wins(rows.select("doc_id", "source", F.sha2("text", 256).alias("sha")), F.col("sha"), ["doc_id"], "source")
    return kept.select("content", "doc_id", (F.size("duplicate_names") + F.when(F.col("source").isNull(), 0).otherwise(1)).cast("bigint").alias("names_n"))


@query(f"""with {PARAGRAPHS} select s.source_id, s.kind, s.status, s.n_limits, coalesce(p.n, 0) as n_paragraphs from
 (select source_id, kind, status, max(coalesce(len(limitations), 0)) as n_limits from sources group by 1, 2, 3) s left join (select source_id, count(*) as n from paragraphs group by 1) p on s.source_id = p.source_id""")
def list_inventory(spark: SparkSession, d: str) -> DataFrame:
    """One row per source with counts of its parts."""
    rows = sources(spark, d).groupBy("source_id", "kind", "status").agg(F.max(F.coalesce(F.array_size("limitations"), F.lit(0))).alias("n_limits"))
    counts = paragraphs(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    return rows.join(counts, "source_id", "left").select("source_id", "kind", "status", "n_limits", F.coalesce("n", F.lit(0)).alias("n_paragraphs"))


@query(f"""with {PARAGRAPHS} select source_id, count(*) as paragraphs, count(*) filter (where kind = 'heading') as headings, count(*) filter (where coalesce(text, '') = '') as empty_lines,
  coalesce(sum(length(text)), 0)::bigint as characters, coalesce(sum(len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\([^)]+\\)'))), 0)::bigint as visual_links from paragraphs group by source_id""")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what each source holds."""
    links = F.size(F.regexp_extract_all("text", F.lit(r"(!\[[^\]]*\]\([^)]+\))"), 1))
    return paragraphs(spark, d).groupBy("source_id").agg(
        F.count("*").alias("paragraphs"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_lines"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), links)), F.lit(0)).alias("visual_links")
    )


@query(f"""with {LATEST} select owner_id, locator.part as part, count(*) as cells, count(*) filter (where coalesce(trim(text), '') = '') as empty, bool_and(coalesce(trim(text), '') = '') as all_empty from latest where kind in ('csv_cell', 'native_cell', 'gap') group by 1, 2""")
def empty_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an owner with the number of cells that hold nothing but blanks."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    rows = units(spark, d, "text").where(F.col("kind").isin("csv_cell", "native_cell", "gap"))
    return rows.groupBy("owner_id", F.col("locator.part").alias("part")).agg(F.count("*").alias("cells"), F.count_if(blank).alias("empty"), F.bool_and(blank).alias("all_empty"))


@query("""select part, bit_xor(('0x' || substr(sha256(line), 1, 15))::bigint) as signature, count(*) as n from (
  select distinct unit_id || ' ' || revision::varchar || ' ' || coalesce(fingerprint, '') as line, substr(sha256(unit_id), 1, 2) as part from units) x group by part""")
def signature(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of 256 parts of the unit table: equal parts have equal rows, in whatever order. Digests of
    different rows are combined by exclusive or, before the shuffle, and can't overflow however many there are."""
    rows = table(spark, d, "units").select(F.concat_ws(" ", "unit_id", F.col("revision").cast("string"), F.coalesce("fingerprint", F.lit(""))).alias("line"), F.substring(F.sha2("unit_id", 256), 1, 2).alias("part")).distinct()
    digest = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy("part").agg(F.bit_xor(digest).alias("signature"), F.count("*").alias("n"))


@query("select event_id, user_id, event_type, (json_extract_string(props, '$.k'))::bigint as k from events")
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows with their payload parsed."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select o_orderkey, 'O' || lpad(row_number() over (order by o_orderkey)::varchar, greatest(5, length(row_number() over (order by o_orderkey)::varchar))::int, '0') as occurrence_id from orders""")
def occurrence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences numbered in scan order."""
    return un.occurrence_ids(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("""with used as (select o_custkey, max(o_orderkey) as top from orders group by 1) select c_custkey, coalesce(top, 0) as top from customer left join used on c_custkey = o_custkey""")
def max_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The highest occurrence of each owner, 0 where there is none."""
    used = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("top"))
    return table(spark, d, "customer").select("c_custkey").join(used, "c_custkey", "left").select("c_custkey", F.coalesce("top", F.lit(0)).alias("top"))


