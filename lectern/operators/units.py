"""Reading units: lines, fences, section paths, clauses, ids and neighbourhoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import materialize

# What begins a fence, and what a heading looks like.
FENCE_MARKS = ("```", "~~~")
HEADING = re.compile(r"(#{1,6})\s+(.+)$")


def text_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line_id, line) of each text; one row per line, numbered from 1."""
    rows = documents.select(key, F.posexplode(tx.lines(F.col(text))).alias("n", "line"))
    return rows.select(key, (F.col("n") + 1).alias("line_no"), F.format_string("L%06d", F.col("n") + 1).alias("line_id"), "line")


LINES = pa.schema([("line_no", pa.int32()), ("line", pa.string()), ("kind", pa.string()), ("heading_level", pa.int32()), ("section_path", pa.list_(pa.string()))])


def fold(texts: list[str]) -> tuple[np.ndarray, pa.Table]:
    """The lines of texts, as the number of the text of each and a table of ``LINES``.

    All lines of a batch are one sequence of arrays: a line is fenced if the marks of its text up to it are
    odd in number, and its section path is that of the last heading before it."""
    split = [t.splitlines() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(split)), sizes)
    line = [x for lines in split for x in lines]
    first = np.cumsum(sizes) - sizes
    marks = np.cumsum(np.fromiter((x.lstrip().startswith(FENCE_MARKS) for x in line), np.int64, len(line)))
    before = np.concatenate(([0], marks))[first]  # marks before each text
    fenced = (marks - np.repeat(before, sizes)) % 2 == 1
    levels = np.zeros(len(line), np.int32)
    paths: list[list[str]] = [[]]
    at = np.zeros(len(line), np.int64)  # where a heading changes the path
    last = -1
    for i in [i for i in np.flatnonzero(~fenced).tolist() if line[i][:1] == "#"]:
        heading = HEADING.match(line[i])
        if heading is not None:
            above = paths[-1] if owner[i] == last else []
            levels[i], last = len(heading[1]), owner[i]
            paths.append([*above[: levels[i] - 1], heading[2]])
            at[i] = len(paths) - 1
    # the last heading of the same text: the greatest number so far, none before the text's first
    seen = np.maximum.accumulate(at) if len(at) else at
    seen[seen <= np.repeat(np.concatenate(([0], seen))[first], sizes)] = 0
    kind = np.where(fenced, "code", np.where(levels > 0, "heading", "text"))
    columns = [np.arange(len(line)) - np.repeat(first, sizes) + 1, line, kind, pa.array(levels, mask=levels == 0), [paths[i] for i in seen.tolist()]]
    return owner, pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, LINES, strict=True)], schema=LINES)


def folded_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, line_no, line, kind, heading_level, section_path) of the lines of each text.

    A fence marker toggles before its own line is labelled, so the opening one is code and the closing
    one text. A heading replaces the path from its level on; levels that are skipped leave no gap. The
    state of a line depends on all lines before it, which no built-in expression carries on without
    copying what it has built; the fold runs in Arrow batches, linear in the text and without a shuffle."""
    kept = [key, *carry]
    of = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, lines = fold([t or "" for t in b.column(len(kept)).to_pylist()])
            own = [b.column(i).take(pa.array(owner)) for i in range(len(kept))]
            yield from pa.Table.from_arrays([*own, *lines.columns], names=[*kept, *LINES.names]).combine_chunks().to_batches()

    return documents.select(*kept, text).mapInArrow(run, f"{of}, line_no int, line string, kind string, heading_level int, section_path array<string>")


def line_clauses(lines: DataFrame, key: str = "doc_id", line: str = "line", indivisible: Column | None = None) -> DataFrame:
    """(key, line_no, start, end, clause) of each line."""
    found = lines.select(key, "line_no", F.inline(tx.clauses(F.col(line), indivisible)))
    return found.withColumnRenamed("text", "clause")


def unit_rows(lines: DataFrame, owner: Column, part: Column) -> DataFrame:
    """Paragraph and clause units of folded lines, in one shape; ids and fingerprints come from content. Each
    line gives all its units at once, so that lines are made once.

    lines: line_no, line, kind, heading_level, section_path besides what owner and part need."""
    whole = F.col("heading_level").isNotNull() | (F.col("kind") == "code")
    nothing = F.lit(None).cast("int")
    unit = lambda kind, start, end, text, required: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), text.alias("text"), F.lit(required).alias("required"))
    clauses = F.transform(tx.clauses(F.col("line"), whole), lambda c: unit("clause", c["start"], c["end"], c["text"], True))
    made = F.concat(F.array(unit("paragraph", nothing, nothing, F.col("line"), False)), clauses)
    place = [owner.alias("owner_id"), part.alias("part"), F.format_string("L%06d", "line_no").alias("paragraph")]
    rows = lines.select(*place, F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), F.inline(made))
    return with_identity(rows.select("owner_id", "kind", "part", "paragraph", "start", "end", "text", "required", "section_path"))


def with_identity(units: DataFrame) -> DataFrame:
    """unit_id from kind, owner and locator; fingerprint from the whole row."""
    locator = F.struct("end", "paragraph", "part", "start")
    identity = tx.canonical(("kind", F.col("kind")), ("locator", locator), ("owner", F.col("owner_id")))
    named = units.withColumn("unit_id", tx.content_id("U", identity))
    row = tx.canonical(("id", F.col("unit_id")), ("kind", F.col("kind")), ("locator", locator), ("owner_id", F.col("owner_id")), ("required", F.col("required")), ("section_path", F.col("section_path")), ("text", F.col("text")))
    return named.withColumn("fingerprint", F.sha2(row, 256))


def latest_units(units: DataFrame) -> DataFrame:
    """The current row of each unit: highest revision, then latest arrival; by an aggregation that combines
    before the shuffle."""
    others = [c for c in units.columns if c not in ("unit_id", "revision", "arrived_at")]
    last = units.groupBy("unit_id").agg(F.max(F.struct("revision", "arrived_at", F.coalesce("fingerprint", F.lit("")).alias("f"), F.struct(*others).alias("rest"))).alias("last"))
    return last.select("unit_id", "last.revision", "last.arrived_at", *[F.col(f"last.rest.`{c}`").alias(c) for c in others])


def required_units(units: DataFrame) -> DataFrame:
    """Units that have to be read: required and not retired."""
    return units.where(F.col("required") & ~F.coalesce(F.col("retired"), F.lit(False)))


def neighbours(rows: DataFrame, key: str, order: list[str], value: str, reach: int = 2) -> DataFrame:
    """(key, order, value, neighbours): the values of at most ``reach`` rows of the same key before and after,
    in order, without the own one.

    Rows are numbered over all keys and meet by equal numbers; a key that many rows have is spread over
    many tasks, as it would not be in a window of this key."""
    placed = numbered(rows.select(key, *order, *({value} - set(order))), [key, *order])
    near = placed.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.col("n").alias("__n"), F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1) if i])).alias("__by"))
    near = near.select("__key", "__value", "__by", (F.col("__n") - F.col("__by")).alias("n"))
    joined = placed.join(near, "n", "left")
    same = F.col("__key").eqNullSafe(F.col(key)) & F.col("__by").isNotNull()
    held = F.array_sort(F.collect_list(F.when(same, F.struct("__by", "__value"))))
    return joined.groupBy("n").agg(*[F.first(c).alias(c) for c in placed.columns if c != "n"], F.transform(held, lambda x: x["__value"]).alias("neighbours")).drop("n")


def nearby_text(lines: DataFrame, key: str = "doc_id", reach: int = 3, size: int = 1500) -> DataFrame:
    """(key, line_no, nearby) of non-blank lines around each line, the own one included, each cut to ``size``."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, reach)
    shown = F.when(F.col("line").rlike(r"(?U)\S"), F.substring("line", 1, size))
    return lines.select(key, "line_no", F.collect_list(shown).over(w).alias("nearby"))


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_n: str, right_n: str, reach: int) -> DataFrame:
    """Rows of both sides with equal keys and numbers at most ``reach`` apart, by an equi-join: the right
    number is exploded to the ``2 * reach + 1`` values it may meet, so no pair is built to be dropped."""
    spread = right.withColumn("__at", F.explode(F.sequence(F.col(right_n) - reach, F.col(right_n) + reach)))
    joined = left.withColumn("__at", F.col(left_n)).join(spread, [*keys, "__at"])
    return joined.drop("__at")


def numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with n, their number from 1 over all rows in order.

    Rows are range-sorted and written once; each range is numbered by itself and shifted by the count of
    rows before it, so the number is global without one task sorting everything."""
    ranges = rows.repartitionByRange(*([parts] if parts else []), *[F.col(c) for c in order])
    held = materialize(ranges.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = held.groupBy("__part").agg(F.count("*").alias("__count"), F.min("__at").alias("__first"))
    # one row per range
    before = counts.select("__part", "__first", F.expr("coalesce(sum(__count) over (order by __part rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn("n", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before")


def occurrence_ids(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with occurrence_id O%05d, numbered over all rows in scan order."""
    return numbered(rows, order, parts).withColumn("occurrence_id", F.format_string("O%05d", "n")).drop("n")
