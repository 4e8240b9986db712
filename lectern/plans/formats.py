"""Queries on office formats: each source becomes a file of a format, which the readers read again.

The files are made in Arrow batches from the paragraphs of a source and never leave the job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import file_kind
from lectern.operators import transactions as tr
from lectern.operators import units as un
from lectern.plans import sqltext as sq
from lectern.sources import jsonl
from lectern.sources import office as of
from lectern.sources import packages as pk
from lectern.session import step_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


CLEAN = "regexp_replace(coalesce({0}, ''), '[\x01-\x08\x0b\x0c\x0e-\x1f￾￿]', '', 'g')"
#: paras: the paragraphs of each source that has any, numbered.
PARAS = f"""one as (select source_id, any_value(name) as name, any_value(structure.paragraphs) as ps from sources where len(structure.paragraphs) > 0 group by source_id),
paras as (select source_id, name, i, 'P' || lpad(i::varchar, greatest(4, length(i::varchar))::int, '0') as paragraph, {CLEAN.format("p.text")} as text, p.heading_level as level, p.kind as kind, p.id as id
  from (select source_id, name, unnest(ps) as p, generate_subscripts(ps, 1) as i from one) x)"""


def made(spark: SparkSession, d: str, kind: str, write: Callable[[str, list[dict]], bytes]) -> DataFrame:
    """(source_id, path, sha256, kind, content): a file of each source that has paragraphs; repeated rows of a
    source are equal, of others the greatest counts."""
    rows = table(spark, d, "sources").where("size(structure.paragraphs) > 0").groupBy("source_id").agg(F.max(F.struct("name", "structure.paragraphs")).alias("one"))
    rows = rows.select("source_id", "one.name", F.col("one.paragraphs").alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [write(name or "", ps) for name, ps in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["source_id", "content"])

    files = rows.mapInArrow(run, "source_id string, content binary")
    return files.select("source_id", F.concat("source_id", F.lit(f".{kind}")).alias("path"), F.sha2("content", 256).alias("sha256"), F.lit(kind).alias("kind"), "content")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, "docx", lambda name, ps: pk.text_document(ps))


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, "xlsx", lambda name, ps: pk.workbook([[p["id"], p["text"] or "", None] for p in ps], sum(p["kind"] == "heading" for p in ps)))


@query(f"with {PARAS} select source_id, paragraph, text, level as heading_level from paras")
def docx_read(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of text documents outside of tables."""
    return of.relation(documents(spark, d), "paragraphs").where("table_id is null").select("source_id", "paragraph", "text", "heading_level")


@query(f"""with recursive {PARAS}, heads as (select *, row_number() over (partition by source_id order by i) as n from paras where level is not null and trim(text) <> ''),
walk as (select source_id, n, paragraph, [trim(text)] as path from heads where n = 1 union all select h.source_id, h.n, h.paragraph, list_append(w.path[:h.level - 1], trim(h.text)) from walk w join heads h on h.source_id = w.source_id and h.n = w.n + 1)
select source_id, paragraph, array_to_string(path, ' > ') as path from walk""")
def docx_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Headings of text documents with their section paths; levels come from styles."""
    return of.relation(documents(spark, d), "paragraphs").where("heading_level is not null and trim(text) <> ''").select("source_id", "paragraph", F.array_join("section_path", " > ").alias("path"))


@query(f"with {PARAS} select source_id, paragraph, length(text) as characters from paras where text <> ''")
def run_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The length that the runs of each paragraph add up to: the end of the last one."""
    runs = of.relation(documents(spark, d), "runs").where("text <> ''")
    inside = of.relation(documents(spark, d), "paragraphs").where("table_id is null").select("source_id", "paragraph")
    return runs.join(inside, ["source_id", "paragraph"]).groupBy("source_id", "paragraph").agg(F.max("end").cast("bigint").alias("characters"))


ISLANDS = f"""{PARAS}, marked as (select *, case when kind is distinct from lag(kind) over (partition by source_id order by i) or i = 1 then 1 else 0 end as fresh from paras),
islands as (select *, sum(fresh) over (partition by source_id order by i) as island from marked), spans as (select *, count(*) over (partition by source_id, island) as n, min(i) over (partition by source_id, island) as first from islands)"""
CELL = "'T001.R' || lpad({0}::varchar, greatest(3, length({0}::varchar))::int, '0') || '.C01'"


@query(f"with {ISLANDS} select source_id, {CELL.format('i')} as cell_id, case when fresh = 1 then n else 1 end as rowspan, case when fresh = 0 then {CELL.format('first')} end as inherited_from from spans")
def vmerge(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the first column with their vertical merges."""
    return of.relation(documents(spark, d), "table_cells").where("grid_column = 1").select("source_id", "cell_id", F.col("rowspan").cast("bigint").alias("rowspan"), "inherited_from")


@query(f"with {PARAS}, n as (select source_id, count(*) as n from paras group by 1) select p.source_id, 'P' || lpad((n.n + 2 * i - 1)::varchar, greatest(4, length((n.n + 2 * i - 1)::varchar))::int, '0') as paragraph, {CELL.format('i')} as cell_id from paras p join n on p.source_id = n.source_id")
def table_context(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with the cell that they stand in."""
    files = documents(spark, d)
    cells = of.relation(files, "table_cells").where("grid_column = 1").select("source_id", "cell_id", F.explode("paragraphs").alias("paragraph"))
    return of.relation(files, "paragraphs").where("table_id is not null").select("source_id", "paragraph").join(cells, ["source_id", "paragraph"])


@query(f"with {ISLANDS} select source_id, {CELL.format('i')} as cell_id from spans where i <= 3 and exists (select 1 from spans t where t.source_id = spans.source_id and t.i = 3) or i in (select first from spans s where s.source_id = spans.source_id and s.i = 3) union select source_id, {CELL.format('i')} from spans where i <= 2")
def table_rows_context(spark: SparkSession, d: str) -> DataFrame:
    """Cells that explain the third row of each table."""
    return of.table_rows(of.relation(documents(spark, d), "table_cells"), "T001", 3).where("grid_column = 1").select("source_id", "cell_id")


@query(f"""with {PARAS}, s as (select distinct source_id from paras) select source_id, style, chain from s cross join (values ('Plain', 'Plain'), ('Struck', 'Struck'), ('H1', 'H1 > Struck'), ('H2', 'H2 > Plain'), ('H3', 'H3 > Plain'), ('H4', 'H4 > Plain'), ('H5', 'H5 > Plain'), ('H6', 'H6 > Plain')) v(style, chain)""")
def style_chain(spark: SparkSession, d: str) -> DataFrame:
    """Styles of text documents with those that they are based on."""
    return of.relation(documents(spark, d), "styles").where("broken is null").select("source_id", "style", F.array_join("chain", " > ").alias("chain"))


@query(f"with {PARAS} select source_id, i::varchar as comment_id, text, paragraph from paras where level is not null")
def comment_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Comments with the paragraphs that they are anchored to."""
    return of.relation(documents(spark, d), "comments").select("source_id", "comment_id", "text", F.explode("anchors").alias("paragraph"))


@query(f"""with {PARAS}, t as (select source_id, paragraph, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as target from paras)
select source_id, paragraph, case when contains(target, '://') then target else 'word/' || target end as target, case when contains(target, '://') then 'external' else 'resolved' end as status from t""")
def rel_resolution(spark: SparkSession, d: str) -> DataFrame:
    """References with what their relationship leads to."""
    return of.relation(documents(spark, d), "references").select("source_id", "paragraph", "target", "status")


@query(f"""with {PARAS}, t as (select source_id, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as target from paras)
select distinct source_id, case when contains(target, '://') then target else 'word/' || target end as target, 'pending' as status from t""")
def visual_status(spark: SparkSession, d: str) -> DataFrame:
    """What is shown, and whether as more than an icon."""
    return of.visual_status(of.relation(documents(spark, d), "references"))


@query(f"with {PARAS} select source_id, paragraph from paras where level = 1 and trim(text) <> ''")
def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with formatting that matters: here, headings whose style strikes them through."""
    return of.annotations(of.relation(documents(spark, d), "runs")).select("source_id", "paragraph").distinct()


@query("select distinct coalesce(name, '') as text from sources where len(structure.paragraphs) > 0")
def nested_expand(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents embedded in documents, each content once."""
    leaf = lambda name: pk.text_document([{"text": name, "kind": "text"}])
    files = made(spark, d, "docx", lambda name, ps: pk.text_document([], pk.text_document([], leaf(name))))
    found = of.expand(files).where("parent_id is not null")
    return of.relation(found, "paragraphs").where("table_id is null and text <> ''").select("text").distinct()


@query(f"""with {PARAS} select source_id, i::int as "row", 1 as "column", id as value from paras union all select source_id, i::int, 2, text from paras union all select source_id, i::int, 3, kind from paras where level is null""")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of CSV files; rows of headings are shorter."""
    files = made(spark, d, "csv", lambda name, ps: pk.csv_file([[p["id"], pk.clean(p["text"]), *([p["kind"]] if p["heading_level"] is None else [])] for p in ps]))
    return of.relation(files, "csv_cells").select("source_id", "row", "column", "value")


SHEET = f"""{PARAS}, cells as (select source_id, i, 'A' || i as address, id as value, null as formula, true as cached_result_present from paras union all select source_id, i, 'B' || i, text, null, false from paras union all select source_id, i, 'C' || i, null, 'A' || i, false from paras)"""


@query(f"with {SHEET} select source_id, address, value, formula, cached_result_present from cells")
def xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of workbooks, formulas without stored results included."""
    return of.relation(workbooks(spark, d), "sheet_cells").select("source_id", "address", "value", "formula", "cached_result_present")


@query(f"with {SHEET} select source_id, address, value from cells where i in (1, 2, 5)")
def sheet_context(spark: SparkSession, d: str) -> DataFrame:
    """Cells that explain cell B5 of each sheet."""
    return of.sheet_context(of.relation(workbooks(spark, d), "sheet_cells"), "S", "B5").select("source_id", "address", "value")


@query(f"with {SHEET} select source_id, address, value from cells where address in ('A1', 'B1')")
def cell_select(spark: SparkSession, d: str) -> DataFrame:
    """Two cells of each sheet by address."""
    return of.select_cells(of.relation(workbooks(spark, d), "sheet_cells"), "S", ["A1", "B1"]).select("source_id", "address", "value")


_ID = """'U' || substr(sha256('{"kind":"' || kind || '","locator":{"end":null,"paragraph":"' || paragraph || '","part":"' || part || '","start":null},"owner":"' || source_id || '"}'), 1, 24)"""


@query(f"""with {SHEET}, n as (select source_id, count(*) as n from paras where kind = 'heading' group by 1),
u as (select source_id, 'native_cell' as kind, 'S' as part, address as paragraph, coalesce(formula, value) as text from cells where formula is not null or coalesce(value, '') <> ''
  union all select source_id, 'shape', 'visio/pages/page1.xml', i::varchar, trim(text) from paras)
select source_id as owner_id, kind, part, paragraph, text, {_ID} as unit_id from u
union all select source_id, 'gap', 'xl/charts/chart' || unnest(range(1, n + 1)) || '.xml', null, null, null from n""")
def office_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of workbooks and diagrams; of gaps only the place is compared."""
    diagrams = made(spark, d, "vsdx", lambda name, ps: pk.diagram([p["text"] for p in ps]))
    rows = of.unit_rows(workbooks(spark, d), ["native_cell", "gap"]).unionByName(of.unit_rows(diagrams, ["shape"]))
    return rows.select("owner_id", "kind", "part", "paragraph", "text", F.when(F.col("kind") != "gap", F.col("unit_id")).alias("unit_id"))


@query(f"with {PARAS}, n as (select source_id, count(*) as n from paras where kind = 'heading' group by 1) select source_id, 'xl/charts/chart' || unnest(range(1, n + 1)) || '.xml' as member from n")
def native_part_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts of packages that no reader understands."""
    return of.relation(workbooks(spark, d), "members").where("native_gap").select("source_id", "member")


@query(f"with {PARAS} select source_id, i::varchar as shape_id, case when i > 1 then (i - 1)::varchar end as parent_shape_id, trim(text) as text from paras")
def vsdx_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of diagrams, each within the one before."""
    files = made(spark, d, "vsdx", lambda name, ps: pk.diagram([p["text"] for p in ps]))
    return of.relation(files, "shapes").where("kind = 'shape'").select("source_id", "shape_id", "parent_shape_id", "text")


@query("""with r as (select source_id, row_number() over (order by source_id) % 4 as k from (select distinct source_id from sources) s)
select source_id || case k when 0 then '.docx' when 1 then '.txt' when 2 then '.xyz' else '.csv' end as path from r where k < 3""")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Files that no reader can read: a text document that is no package, a text that is no UTF-8, an unknown
    kind; every fourth file is sound."""
    rows = un.numbered(table(spark, d, "sources").select("source_id").distinct(), ["source_id"]).withColumn("k", F.col("n") % 4)
    suffix = F.when(F.col("k") == 0, ".docx").when(F.col("k") == 1, ".txt").when(F.col("k") == 2, ".xyz").otherwise(".csv")
    path = F.concat("source_id", suffix)
    files = rows.select("source_id", path.alias("path"), file_kind(path).alias("kind"), F.when(F.col("k") == 3, F.encode(F.lit("a,b"), "utf-8")).otherwise(F.unhex(F.lit("FF10"))).alias("content"))
    return of.gaps(files).select("path")


@query("""select distinct doc_id, line_no, line, kind from (select l.*, case when f then 'code' when regexp_matches(line, '^#{1,6}\\s+.+$') then 'heading' else 'text' end as kind from (
  select *, (sum(case when regexp_matches(line, '^\\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by line_no) % 2) = 1 as f from lines) l)""".replace("select distinct", f"with {sq.LINES} select distinct", 1))
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of Markdown files, read from their bytes."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_id"), F.concat("doc_id", F.lit(".md")).alias("path"), F.lit("markdown").alias("kind"), F.encode("text", "utf-8").alias("content"))
    return of.relation(docs, "lines").select(F.col("source_id").cast("bigint").alias("doc_id"), "line_no", "line", "kind").distinct()


@query("select distinct unit_id, revision, text from units")
def scan_units(spark: SparkSession, d: str) -> DataFrame:
    """Units written as JSON Lines with the digests of their files, which are compared when they are read again."""
    folder = f"{step_dir(spark)}/units-{uuid.uuid4().hex}"
    jsonl.write_units(table(spark, d, "units").select("unit_id", "revision", "text").distinct(), folder)
    return jsonl.read_checked(spark, folder, "unit_id string, revision bigint, text string").select("unit_id", "revision", "text")


VIEWS = "views as (select distinct unit_id || ' ' || run_no || ' ' || attempt || ' ' || stage as view_id, unit_id, unit_fingerprint, notes from readings), held as (select unit_id, max(fingerprint) as f, bool_and(kind = 'gap') as icon from units group by 1)"


@query(f"with {VIEWS} select view_id as subject, 'rendition' as rule from views v left join held h on v.unit_id = h.unit_id where v.unit_fingerprint is distinct from h.f union select view_id, 'icon' from views v join held h on v.unit_id = h.unit_id where icon union select view_id, 'observation' from views where coalesce(trim(notes), '') = ''")
def view_validity(spark: SparkSession, d: str) -> DataFrame:
    """Rules that visual readings break; of units that are gaps only an icon is there to be seen."""
    views = table(spark, d, "readings").select(F.concat_ws(" ", "unit_id", F.col("run_no").cast("string"), F.col("attempt").cast("string"), "stage").alias("view_id"), F.col("unit_id").alias("rendition_id"), F.col("unit_fingerprint").alias("sha256"), F.lit("reader").alias("tool"), F.col("notes").alias("observation")).distinct()
    held = table(spark, d, "units").groupBy(F.col("unit_id").alias("rendition_id")).agg(F.max("fingerprint").alias("sha256"), F.when(F.bool_and(F.col("kind") == "gap"), "icon").otherwise("page").alias("role"))
    return tr.view_violations(views, held)


@query("select run_no as revision, count(distinct unit_id || ' ' || unit_fingerprint) as views, count(distinct stage) as records from readings group by 1")
def view_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Views kept once per run, and records that refer to them."""
    events = table(spark, d, "readings").select(F.col("run_no").alias("revision"), F.col("stage").alias("record_id"), F.struct("unit_id", "unit_fingerprint").alias("view"))
    views, records = tr.compact_views(events)
    return views.groupBy("revision").agg(F.count("*").alias("views")).join(records.groupBy("revision").agg(F.count("*").alias("records")), "revision")
