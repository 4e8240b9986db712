"""Items of varying length in containers of a fixed capacity, by bulk-synchronous best fit.

Items are range-sorted by size; gaps (the space left in open containers) are kept sorted too. In each
superstep one sweep over both, from the greatest down, gives every item the smallest gap that it fits
in (its successor); if several items ask for the same gap, ranks decide, and each container takes one
item per superstep. Then gaps are updated, and the next superstep follows; when no gap fits any item,
containers are opened, as many as the items left fill at least.

Sizes are whole numbers up to the capacity, so both sorted sequences are held run-length coded: items
of one size are a range of ranks, containers with one gap a range of ids, and a sweep matches ranges
with ranges. A superstep so depends on the capacity, not on the number of items; what is distributed
over rows is the sort, the ranks and the join of ranges with items. The plan of a window is made in one
task from the counts of at most ``capacity`` sizes.

Cases: items larger than the capacity are split into full pieces and a rest, all others stay whole;
items of size 0 (null and empty texts) take no space and are spread over the containers; an empty table
gives an empty result; windows without a positive capacity have no containers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.session import materialize

#: Windows that items are packed for in one call.
MOST_WINDOWS = 1000
#: Ranks in one part of the join of ranges with items.
PART = 512


def sweep(items: list[list[int]], gaps: dict[int, list[tuple[int, int]]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, list[tuple[int, int]]]]:
    """One superstep. items: [size, first rank left, number left], greatest first; gaps: ranges of
    containers by gap. Returns matches (size, first rank, n, first container, gap) and the gaps after."""
    matches = []
    after: dict[int, list[tuple[int, int]]] = defaultdict(list)
    waiting = sorted(gaps)
    open_: list[tuple[int, int, int]] = []
    for item in items:
        size = item[0]
        while waiting and waiting[-1] >= size:
            gap = waiting.pop()
            open_ += [(gap, first, n) for first, n in gaps[gap]]
        while item[2] and open_:
            gap, first, n = open_.pop()
            m = min(n, item[2])
            matches.append((size, item[1], m, first, gap))
            item[1] += m
            item[2] -= m
            after[gap - size].append((first, m))
            if n > m:
                open_.append((gap, first + m, n - m))
    for gap, first, n in open_:
        after[gap].append((first, n))
    for gap in waiting:
        after[gap] += gaps[gap]
    return matches, after


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (size, first rank, n, first container, offset) for counts of items by size, and the number
    of containers."""
    items = [[size, 0, n] for size, n in sorted(counts.items(), reverse=True) if size > 0 and n > 0]
    gaps: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    containers = 0
    while items:
        left = sum(size * n for size, _, n in items)
        more = min(-(-left // capacity), sum(n for _, _, n in items))
        gaps.setdefault(capacity, []).append((containers, more))
        containers += more
        while True:
            matches, gaps = sweep(items, gaps)
            out += [(size, rank, n, first, capacity - gap) for size, rank, n, first, gap in matches]
            items = [x for x in items if x[2]]
            if not matches or not items:
                break
            least = items[-1][0]
            gaps = {g: runs for g, runs in gaps.items() if g >= least}
    return out, containers


def pieces(sizes: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(window_id, capacity, key, piece_no, start_token, n_tokens): items cut where they exceed the capacity.

    Each item goes into each window, so this takes a row for each of both; windows are a handful, which is
    checked before they are broadcast."""
    few = windows.select("window_id", "capacity")
    if few.limit(MOST_WINDOWS + 1).count() > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    rows = sizes.select(key, "n_tokens").crossJoin(F.broadcast(few))
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0))
    rows = rows.select("window_id", "capacity", key, F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    return rows.select("window_id", "capacity", key, "piece_no", start.alias("start_token"), F.least(F.col("whole") - start, "capacity").alias("n_tokens"))


def ranked(rows: DataFrame, key: str, folder_label: str = "sorted") -> DataFrame:
    """``rows`` with the rank of each among those of its window and size, without a window over one size.

    Rows are range-sorted (a size that many rows have is spread over several ranges) and counted within
    their range; ranges then get the counts before them. These counts are as many as sizes and ranges."""
    order = ["window_id", "n_tokens", key, "piece_no"]
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    at = {name: rows.schema.fieldNames().index(name) for name in ("window_id", "n_tokens")}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for b in batches:
            places = []
            for run in zip(b.column(at["window_id"]).to_pylist(), b.column(at["n_tokens"]).to_pylist(), strict=True):
                place = place + 1 if run == last else 0
                last = run
                places.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "place"])

    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, ", ".join([*columns, "place bigint"]))
    numbered = materialize(numbered.withColumn("range_no", F.spark_partition_id()), folder_label)
    counts = numbered.groupBy("window_id", "n_tokens", "range_no").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by window_id, n_tokens order by range_no rows between unbounded preceding and 1 preceding), 0)")
    counts = counts.select("window_id", "n_tokens", "range_no", before.alias("before"))
    return numbered.join(counts, ["window_id", "n_tokens", "range_no"]).withColumn("rank", F.col("before") + F.col("place")).drop("place", "before", "range_no")


def pack(sizes: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(window_id, key, piece_no, start_token, n_tokens, container_id, container_offset), one row per piece.

    sizes: (key, n_tokens); windows: (window_id, capacity)."""
    windows = windows.where("capacity > 0").select("window_id", "capacity").distinct()
    cut = materialize(pieces(sizes, windows, key), "pieces")
    rows = ranked(cut.where("n_tokens > 0"), key)
    counts = rows.groupBy("window_id", "capacity", "n_tokens").agg(F.count("*").alias("n"))

    def ranges(group: pd.DataFrame) -> pd.DataFrame:
        found, containers = plan(dict(zip(group["n_tokens"].tolist(), group["n"].tolist(), strict=True)), int(group["capacity"].iloc[0]))
        out = pd.DataFrame(found, columns=["n_tokens", "first_rank", "n", "first_container", "container_offset"])
        out["window_id"], out["containers"] = group["window_id"].iloc[0], containers
        return out

    kind = windows.schema["window_id"].dataType.simpleString()
    planned = materialize(counts.groupBy("window_id").applyInPandas(ranges, f"n_tokens bigint, first_rank bigint, n bigint, first_container bigint, container_offset bigint, window_id {kind}, containers bigint"), "plan")
    parts = planned.select("*", F.explode(F.sequence(F.floor(F.col("first_rank") / PART), F.floor((F.col("first_rank") + F.col("n") - 1) / PART))).alias("part"))
    placed = rows.withColumn("part", F.floor(F.col("rank") / PART)).join(parts, ["window_id", "n_tokens", "part"]).where("rank >= first_rank and rank < first_rank + n")
    placed = placed.select("window_id", key, "piece_no", "start_token", "n_tokens", (F.col("first_container") + F.col("rank") - F.col("first_rank")).alias("container_id"), "container_offset")
    number = F.broadcast(planned.groupBy("window_id").agg(F.max("containers").alias("containers")))  # a row per window
    empty = cut.where("n_tokens = 0").join(number, "window_id", "left").select("window_id", key, "piece_no", "start_token", "n_tokens", F.coalesce(F.pmod(F.xxhash64(key), F.col("containers")), F.lit(0)).alias("container_id"), F.lit(0).cast("bigint").alias("container_offset"))
    return placed.unionByName(empty)


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity, tokens, containers, least, fullest) of packed pieces: how many containers hold
    something, the fewest that could hold all tokens, and the tokens of the fullest one."""
    held = packed.where("n_tokens > 0").groupBy("window_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    rows = held.groupBy("window_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("containers"), F.max("n").alias("fullest"))
    rows = rows.join(windows.select("window_id", "capacity").distinct(), "window_id")
    return rows.select("window_id", "capacity", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "fullest")


def token_sizes(documents: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) by a public tokenizer: byte-level vocabularies by this package's encoder, the others
    by their library. The file is read by the driver and broadcast; it has a fixed size."""
    if tokenizer.startswith("byte_bpe"):
        return bpe.count_tokens(documents, bpe.read_vocabulary(f"{folder}/{tokenizer}.tiktoken"), key, text)
    spark: SparkSession = documents.sparkSession
    pieces_model = tokenizer.startswith("piece")
    with open(f"{folder}/{tokenizer}.{'model' if pieces_model else 'json'}", "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces_model:
            import sentencepiece

            size = sentencepiece.SentencePieceProcessor(model_proto=shared.value).encode
            count = lambda texts: [len(x) for x in size(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(shared.value.decode("utf-8"))
            own.encode_special_tokens = True
            count = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count([t or "" for t in b.column(1).to_pylist()]), pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens bigint")


def pack_documents(documents: DataFrame, windows: DataFrame, folder: str) -> DataFrame:
    """Documents in the containers of each reading window, measured by the window's tokenizer; each
    tokenizer runs once."""
    by = windows.where("tokenizer is not null").select("tokenizer").distinct()
    out = None
    for (tokenizer,) in sorted(by.collect()):  # a handful of windows
        own = windows.where(F.col("tokenizer") == tokenizer).select("window_id", F.col("capacity_tokens").alias("capacity"))
        part = pack(materialize(token_sizes(documents, tokenizer, folder), "sizes"), own)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no window names a tokenizer")
    return out
