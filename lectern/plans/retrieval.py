"""Queries on the index: frequencies, ranked search, expansion, pages, edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import index as ix
from lectern.operators import units as un
from lectern.plans import sqltext as sq
from lectern.plans.reading import LATEST, units
from lectern.session import step_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

TERM, EXPANDED_TERM = "page image", "Reading log"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Index records, each once, with the sources as an array. Repeated rows are equal, so the number tells them;
    columns that a query doesn't use are pruned through the aggregation."""
    rows = table(spark, d, "index_entries").select("entry_no", "entry_id", "entry_type", "kind", "source_id", "name", "section", "body").dropDuplicates(["entry_no"])
    return rows.withColumn("id", F.col("entry_no")).withColumn("source_ids", F.array_compact(F.array("source_id")))


FIELDS = ["name", "body", "section"]
ENTRIES = "docs as (select distinct entry_no, entry_id, entry_type, kind, source_id, name, section, body from index_entries)"
TOKENS = f"""{ENTRIES}, toks as (
  select entry_no, 'name' as field, unnest({sq.tokens("coalesce(name, '')")}) as term from docs union all
  select entry_no, 'body', unnest({sq.tokens("coalesce(body, '')")}) from docs union all
  select entry_no, 'section', unnest({sq.tokens("coalesce(section, '')")}) from docs)"""


@query(f"with {TOKENS} select entry_no as id, field, term, count(*) as tf from toks group by 1, 2, 3")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each token stands in each field of each record."""
    return ix.postings(entries(spark, d), "id", FIELDS)


@query(f"with {TOKENS} select term, count(distinct entry_no) as df from toks group by 1")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    """In how many records each token stands, in whatever field."""
    return ix.doc_frequency(ix.field_tokens(entries(spark, d), "id", FIELDS), "id")


@query(f"with {TOKENS} select term, count(distinct entry_no) as df, count(*) as tf from toks group by 1")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """Headers of the posting lists."""
    return ix.posting_lists(ix.postings(entries(spark, d), "id", FIELDS), "id")


@query(f"with {TOKENS}, p as (select entry_no as id, field, term, count(*) as tf from toks group by 1, 2, 3) select term, string_agg(id || ':' || field || ':' || tf, ' ' order by id, field) as postings from p group by 1")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    """The records of each term, put together from its blocks; in whole only here, where the tables are small."""
    blocks = ix.posting_blocks(ix.postings(entries(spark, d), "id", FIELDS), "id", 512)
    one = blocks.groupBy("term").agg(F.array_sort(F.flatten(F.collect_list("postings"))).alias("postings"))
    return one.select("term", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["id"].cast("string"), p["field"], p["tf"].cast("string"))), " ").alias("postings"))


@query(f"with {TOKENS} select term, count(distinct entry_no) as df, count(*) as tf from toks where term in ('page', 'image', '表') group by 1")
def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """Terms looked up in an index that is stored by term: of its parts only theirs are read."""
    folder = f"{step_dir(spark)}/index-{uuid.uuid4().hex}"
    ix.store_index(ix.postings(entries(spark, d), "id", FIELDS), folder, "id")
    return ix.posting_lists(ix.stored_postings(spark, folder, ["page", "image", "表"]), "id")


def _ranked(term: str, eligible: str = "true", aliases: bool = False, related: bool = False) -> str:
    """SQL of a ranked search; the score as in ``operators.index.search``."""
    wanted = f"select unnest({sq.tokens(repr(term), False)}) as term"
    t = sq.normal(f"'{term}'")
    more = f"select distinct unnest({sq.tokens('n', False)}) as term from names where id in (select id from names where {sq.normal('n')} = {t})" if aliases else "select null as term where false"
    near = """, near as (select e.b as entry_no, max(s.score * 0.25) as score from summed s join edges e on e.a = s.entry_no group by 1),
 every as (select entry_no, score from summed union all select entry_no, score from near where entry_no not in (select entry_no from summed))""" if related else ", every as (select * from summed)"
    return f"""with {TOKENS}, names as (select distinct entry_no as id, unnest([entry_id, name]) as n from docs where entry_type = 'knowledge'), wanted as (select distinct term from ({wanted}) w),
 terms as (select term, 1.0 as factor from wanted union all select term, 0.3 from ({more}) m where term not in (select term from wanted)),
 star as (select entry_no as a, min(entry_no) over (partition by source_id, body) as b from docs where source_id is not null and body is not null),
 edges as (select a, b from star where a <> b union select b, a from star where a <> b),
 hits as (select k.entry_no, k.field, k.term, t.factor, count(*) as tf from toks k join terms t on k.term = t.term group by 1, 2, 3, 4),
 dfs as (select term, count(distinct entry_no) as df from hits group by 1),
 scored as (select h.entry_no, sum(h.factor * case h.field when 'name' then 4.0 when 'body' then 2.0 else 1.5 end * ln(1 + ((select count(*) from docs) + 1) / (d.df + 1)) * (1 + ln(h.tf))) as score
   from hits h join dfs d on h.term = d.term where h.entry_no in (select entry_no from docs where {eligible}) group by 1),
 summed as (select s.entry_no, s.score + case when contains({sq.normal("coalesce(d.name, '')")}, {t}) or contains({sq.normal("coalesce(d.body, '')")}, {t}) then 5 else 0 end as score from scored s join docs d on d.entry_no = s.entry_no)
 {near}
select entry_no as id, round(score, 5) as score from every"""


@query(_ranked(TERM) + " order by score desc, id limit 100")
def search(spark: SparkSession, d: str) -> DataFrame:
    """The best 100 records for a term (the page is the feature)."""
    found = ix.search(entries(spark, d), TERM)
    return ix.page(found, "id", limit=100).select("id", "score")


@query(_ranked(TERM))
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """All records that match a term, scored."""
    return ix.search(entries(spark, d), TERM).select("id", "score")


@query(_ranked(TERM))
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """All records that match a term, from an index that is stored by term."""
    folder = f"{step_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = entries(spark, d)
    ix.store_index(ix.postings(docs, "id", FIELDS), folder, "id")
    return ix.search(docs, TERM, index=ix.stored_postings(spark, folder, tx.token_list(TERM, False))).select("id", "score")


@query(f"select id, score, (select count(*) from ({_ranked(TERM)}) a) as total_hits, case when (select count(*) from ({_ranked(TERM)}) b) > 36 then 36 end as next_offset from ({_ranked(TERM)}) r order by score desc, id limit 12 offset 24")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of results."""
    return ix.page(ix.search(entries(spark, d), TERM), "id", 12, 24).select("id", "score", "total_hits", "next_offset")


@query(_ranked(TERM, "kind = 'clause' and lower(coalesce(section, '')) like '%review%'"))
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    """Search among the records of a kind and section."""
    docs = entries(spark, d)
    return ix.search(docs, TERM, allowed=ix.eligible(docs, section="Review", kind="clause")).select("id", "score")


def knowledge_names(docs: DataFrame) -> DataFrame:
    rows = docs.where("entry_type = 'knowledge'")
    return rows.select("id", F.explode(F.array("entry_id", "name")).alias("name")).where("name is not null").distinct()


@query(_ranked(EXPANDED_TERM, aliases=True))
def search_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Search whose term names knowledge, so that its other names join the query."""
    docs = entries(spark, d)
    return ix.search(docs, EXPANDED_TERM, names=knowledge_names(docs)).select("id", "score")


def twin_edges(docs: DataFrame) -> DataFrame:
    """Edges (a, b) between each record and the first one of its source with the same body, both ways; a group
    of n records has n - 1 such links, not their pairs."""
    rows = docs.where("source_id is not null and body is not null").select("id", "source_id", "body")
    first = rows.groupBy("source_id", "body").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = rows.join(first, ["source_id", "body"]).select(F.col("id").alias("a"), "b", F.lit("same body").alias("reason"))
    return ix.both_ways(star)


@query(_ranked(TERM, related=True))
def search_related(spark: SparkSession, d: str) -> DataFrame:
    """Search with one hop along relationships."""
    docs = entries(spark, d)
    return ix.search(docs, TERM, edges=twin_edges(docs)).select("id", "score")


@query("""with k as (select distinct entry_id, source_id, body from index_entries where entry_type = 'knowledge' and body is not null), u as (select distinct unit_id, owner_id, text from units where text is not null and text <> '')
select distinct k.entry_id as a, u.unit_id as b, 'claim_evidence' as reason from k join u on k.source_id = u.owner_id and k.body = u.text
union select distinct u.unit_id, k.entry_id, 'claim_evidence' from k join u on k.source_id = u.owner_id and k.body = u.text""")
def knowledge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge and the units of its source with the text that it repeats, both ways."""
    k = table(spark, d, "index_entries").where("entry_type = 'knowledge'").select("entry_id", "source_id", F.col("body").alias("text")).distinct()
    u = table(spark, d, "units").where("text <> ''").select("unit_id", F.col("owner_id").alias("source_id"), "text").distinct()
    pairs = k.join(u, ["source_id", "text"]).select(F.col("entry_id").alias("a"), F.col("unit_id").alias("b"), F.lit("claim_evidence").alias("reason"))
    return ix.both_ways(pairs)


@query(f"""with {LATEST}, l as (select unit_id, kind, owner_id, locator.part as part, try_cast(substr(locator.paragraph, 2) as int) as n from latest where regexp_matches(locator.paragraph, '^P[0-9]+$'))
select a.unit_id as gap_unit, b.unit_id as parent_unit from l a join l b on a.owner_id = b.owner_id and a.part is not distinct from b.part and b.n between a.n - 2 and a.n + 2 and a.unit_id <> b.unit_id where a.kind = 'gap' and b.kind <> 'gap'""")
def attachment_edges(spark: SparkSession, d: str) -> DataFrame:
    """Gap units with the units of the same part at most two paragraphs away; numbers begin anew in each part."""
    rows = units(spark, d).where(F.col("locator.paragraph").rlike("^P[0-9]+$")).select("unit_id", "kind", "owner_id", F.coalesce(F.concat(F.lit("p"), "locator.part"), F.lit("")).alias("part"), F.substring("locator.paragraph", 2, 20).cast("int").alias("n"))
    left = rows.where("kind = 'gap'").select(F.col("unit_id").alias("gap_unit"), "owner_id", "part", "n")
    right = rows.where("kind <> 'gap'").select(F.col("unit_id").alias("parent_unit"), "owner_id", "part", F.col("n").alias("at"))
    return un.band_pairs(right, left, ["owner_id", "part"], "at", "n", 2).select("gap_unit", "parent_unit")


@query("""with l as (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem)
select a.l_orderkey, a.l_partkey as part, a.l_linenumber as line, b.l_partkey as near_part, b.l_linenumber as near_line from l a join l b on a.l_orderkey = b.l_orderkey and abs(a.l_linenumber - b.l_linenumber) <= 2 and (a.l_partkey, a.l_suppkey, a.l_linenumber) <> (b.l_partkey, b.l_suppkey, b.l_linenumber)""")
def raster_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences at most two places apart in the same owner."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    near = rows.select("l_orderkey", F.col("l_partkey").alias("near_part"), F.col("l_suppkey").alias("near_supp"), F.col("l_linenumber").alias("near_line"))
    pairs = un.band_pairs(rows, near, ["l_orderkey"], "l_linenumber", "near_line", 2)
    same = (F.col("l_partkey") == F.col("near_part")) & (F.col("l_suppkey") == F.col("near_supp")) & (F.col("l_linenumber") == F.col("near_line"))
    return pairs.where(~same).select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), "near_part", "near_line")


@query(f"""with {LATEST}, k as (select distinct entry_no, source_id, section from index_entries where entry_type = 'knowledge' and kind = 'object'),
 g as (select owner_id, count(*) as n from latest where kind = 'gap' group by 1), c as (select owner_id, array_to_string(section_path, ' > ') as section, count(*) as n from latest where kind = 'comment' group by 1, 2)
select k.entry_no, coalesce(g.n, 0) as gaps, coalesce(c.n, 0) as comments from k left join g on k.source_id = g.owner_id left join c on k.source_id = c.owner_id and k.section = c.section where g.n is not null or c.n is not null""")
def related_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Objects with the number of related units of their source: gaps, and comments under the same section.

    Two equi-joins stand for the 'or', each with counts per group, so a source that many rows have doesn't
    multiply."""
    k = table(spark, d, "index_entries").where("entry_type = 'knowledge' and kind = 'object'").select("entry_no", "source_id", "section").distinct()
    u = units(spark, d).select(F.col("owner_id").alias("source_id"), "kind", F.array_join("section_path", " > ").alias("section"))
    gaps = u.where("kind = 'gap'").groupBy("source_id").agg(F.count("*").alias("gaps"))
    comments = u.where("kind = 'comment'").groupBy("source_id", "section").agg(F.count("*").alias("comments"))
    both = k.join(gaps, "source_id", "left").join(comments, ["source_id", "section"], "left").where("gaps is not null or comments is not null")
    return both.select("entry_no", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("comments", F.lit(0)).alias("comments"))


@query("select distinct l_partkey as target, l_suppkey as reason from lineitem")
def edges_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Edges, each target and reason once."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("reason")).distinct()
