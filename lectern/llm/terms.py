"""Terms, their counts over a collection, and how much they set a record apart.

``term_form`` is the form in which terms are equal (NFKC, case folding, trimming).

``suffix_counts`` counts n-grams of term sequences by sorted suffixes: each sequence gives its
suffixes, truncated to the longest n-gram; they are routed by their first term, sorted in reverse
lexicographic order, and one pass with a stack gives the occurrences and the records of every prefix.
First terms with more than their share of all suffixes are split by record over several tasks, as many as
their count asks for; parts of a split term are added up, as their records are disjoint. ``index_terms``
sends the postings of an index through the same stack.

``log_odds`` gives each term of a record the log-odds ratio of this record against the rest of the
collection, with an informative Dirichlet prior from the collection's counts, over its standard error.

Cases: null and blank terms don't count; repeated rows count once where the functions say so; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata as ud
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.consistent import consistent
from lectern.session import materialize

RUN = re.compile(r"[^\W_]+")


def term_of(text: str) -> str:
    """The form in which terms are compared."""
    return ud.normalize("NFKC", text).casefold().strip()


@F.pandas_udf(T.StringType())
def term_form(terms: pd.Series) -> pd.Series:
    """``term_of`` as a column function; null stays null. Repeated terms of a batch are formed once."""
    forms = {x: term_of(x) for x in terms.dropna().unique()}
    return pd.Series([forms.get(x) for x in terms], dtype=object)


class Stack:
    """The open prefixes of the last suffix, with the occurrences and records counted for each.

    What a closed prefix has counted goes to the one above it. A record that an open prefix has met before
    is taken off there, so that it counts once in every prefix: ``opened`` says when each prefix was opened,
    ``last`` when a record was last met, and the deepest prefix opened before that is the one to correct. So
    no prefix holds a set of records."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.totals: list[int] = []
        self.records: list[int] = []
        self.opened: list[int] = []
        self.last: dict = {}
        self.now = 0

    def close(self, down_to: int = 0) -> Iterator[tuple[list[str], int, int]]:
        while len(self.path) > down_to:
            yield self.path[:], self.totals[-1], self.records[-1]
            self.path.pop()
            self.opened.pop()
            total, records = self.totals.pop(), self.records.pop()
            if self.path:
                self.totals[-1] += total
                self.records[-1] += records
        if not self.path:
            self.last.clear()

    def move(self, terms: list[str]) -> Iterator[tuple[list[str], int, int]]:
        """Make ``terms`` the open prefix; gives those that this closes."""
        same = 0
        while same < len(self.path) and same < len(terms) and self.path[same] == terms[same]:
            same += 1
        yield from self.close(same)
        for term in terms[same:]:
            self.path.append(term)
            self.totals.append(0)
            self.records.append(0)
            self.opened.append(self.now)

    def count(self, n: int, records: int) -> None:
        """Occurrences in so many records that no open prefix has met."""
        self.totals[-1] += n
        self.records[-1] += records

    def meet(self, record: object, n: int) -> None:
        """Occurrences in a record."""
        self.count(n, 1)
        before = self.last.get(record, -1)
        held = bisect_right(self.opened, before) - 1
        if held >= 0:
            self.records[held] -= 1
        self.last[record] = self.now
        self.now += 1


def stack_counts(rows: Iterator[tuple[list[str], int, int]], longest: int) -> Iterator[tuple[list[str], int, int]]:
    """(n-gram, occurrences, records) from suffixes (terms, record, n) in reverse lexicographic order."""
    stack = Stack()
    for terms, record, n in rows:
        yield from stack.move(terms[:longest])
        stack.meet(record, n)
    yield from stack.close()


def _changes(x: pa.Array, before: object) -> np.ndarray:
    """Where a sorted column differs from the row before, the first row from ``before``."""
    out = np.ones(len(x), bool)
    if len(x) > 1:
        out[1:] = pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
    out[0] = x[0].as_py() != before
    return out


def count_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of single terms from rows (head, salt, record, part, n), sorted by all of these and with what
    counts first among equal (head, salt, record, part), where only the first counts.

    The records of a term come in order, so the stack is given whole stretches of a batch at once."""
    stack, salt_now = Stack(), None
    last: list = [None, None, None, None]
    for b in batches:
        if not b.num_rows:
            continue
        head, salt, record, part = (b.column(i) for i in range(4))
        term = _changes(head, last[0]) | _changes(salt, last[1])
        fresh = term | _changes(record, last[2])
        kept = fresh | _changes(part, last[3])
        last = [c[-1].as_py() for c in (head, salt, record, part)]
        n = np.where(kept, b.column(4).to_numpy(), 0)
        starts = np.flatnonzero(term)
        if not len(starts) or starts[0]:
            starts = np.concatenate(([0], starts))
        sums, records = np.add.reduceat(n, starts), np.add.reduceat(fresh.astype(np.int64), starts)
        block: list[tuple[list[str], int, int]] = []
        for name, part_no, opens, total, many in zip(head.take(pa.array(starts)).to_pylist(), salt.take(pa.array(starts)).to_pylist(), term[starts].tolist(), sums.tolist(), records.tolist(), strict=True):
            if opens:
                if part_no != salt_now:
                    block += stack.close()
                    salt_now = part_no
                block += stack.move([name])
            stack.count(total, many)
        if block:
            yield _batch(block)
    if block := list(stack.close()):
        yield _batch(block)


def _parts(heads: DataFrame, share: int) -> DataFrame:
    """(head, parts) of the heads that have more than 1 in ``share`` of all, fewer than ``share`` rows, from
    rows (head, n)."""
    sums = materialize(heads.groupBy("head").agg(F.sum("n").alias("n")), "heads")
    every = sums.agg(F.sum("n").alias("every"))
    return materialize(sums.crossJoin(F.broadcast(every)).where(F.col("n") * share > F.col("every")).select("head", F.ceil(F.col("n") * share / F.col("every")).alias("parts")), "hot")  # every: one row


def suffix_counts(sequences: DataFrame, longest: int = 1, share: int = 4096, record: str = "record", terms: str = "terms", n: str = "n", unique: bool = False) -> DataFrame:
    """(terms, frequency, n_records) of every n-gram of at most ``longest`` terms.

    sequences: a record, an array of terms, and how often this sequence stands in the record. Equal
    truncated suffixes of a record are added up before they are routed; the stack counts the records.
    ``unique`` says that no record has a suffix twice. A first term with more than 1 in ``share`` of all
    suffixes is split by record, so that a task holds about that share of records at most."""
    suffixes = sequences.select(F.col(record).alias("record"), F.col(n).cast("bigint").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms), F.lit(1))), lambda i: F.slice(F.col(terms), i, longest))).alias("s"))
    suffixes = suffixes.where(F.size("s") > 0)
    if not unique:
        suffixes = suffixes.groupBy("record", "s").agg(F.sum("n").alias("n"))
    hot = _parts(suffixes.select(F.col("s")[0].alias("head"), F.lit(1).alias("n")), share)
    routed = suffixes.withColumn("head", F.col("s")[0]).join(F.broadcast(hot), "head", "left")
    routed = routed.select("head", F.pmod(F.xxhash64("record"), F.coalesce("parts", F.lit(1))).alias("salt"), "s", "record", "n")
    routed = routed.repartition("head", "salt").sortWithinPartitions(F.col("salt"), F.col("s").desc(), "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, salt_now = Stack(), None
        for b in batches:
            block: list[tuple[list[str], int, int]] = []
            for salt, terms_, record_, n_ in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if salt != salt_now:
                    block += stack.close()
                    salt_now = salt
                block += stack.move(terms_)
                stack.meet(record_, n_)
            if block:
                yield _batch(block)
        if block := list(stack.close()):
            yield _batch(block)

    part = routed.mapInArrow(run, "terms array<string>, frequency bigint, n_records bigint")
    return part.groupBy("terms").agg(F.sum("frequency").alias("frequency"), F.sum("n_records").alias("n_records"))


def _batch(block: list[tuple[list[str], int, int]]) -> pa.RecordBatch:
    a, b, c = zip(*block, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.string())), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["terms", "frequency", "n_records"])


def index_terms(shards: DataFrame, rare: int = 3, common: float = 0.1, share: int = 4096) -> DataFrame:
    """(term, frequency, n_records, mark) of every term of an index (term, frequency, postings, built_at);
    mark is 'rare' with fewer than ``rare`` records, 'common' with more than the share ``common`` of all
    records, else null.

    Terms are brought to one form. Their postings are the suffixes, of one term each: routed by term (and
    record, where a term has more than 1 in ``share`` of all postings), sorted, and counted with the stack.
    Of postings that name the same term, record and field only the one of the latest build counts, of those
    the one with the greatest n; it comes first in the order. A posting without a count stands for one
    occurrence, one without a record for nothing; a term without any posting that counts is in no record
    and gives no row. The stored frequency is of no use: it is null or wrong where it differs from the
    postings."""
    form = F.pandas_udf(term_form.func, T.StringType()).asNondeterministic()  # so that it isn't repeated for the filter
    rows = shards.where(F.size("postings") > 0).select(form("term").alias("head"), "built_at", "postings").where("head <> ''")
    hot = _parts(rows.select("head", F.size("postings").alias("n")), share)
    records = rows.select(F.explode(F.array_distinct(F.col("postings.entry_no"))).alias("record")).where("record is not null").agg(F.count_distinct("record").alias("all_records"))
    one = rows.join(F.broadcast(hot), "head", "left").select("head", "parts", "built_at", F.explode("postings").alias("p")).where("p.entry_no is not null")
    one = one.select("head", F.pmod(F.xxhash64("p.entry_no"), F.coalesce("parts", F.lit(1))).alias("salt"), F.col("p.entry_no").alias("record"), F.coalesce("p.field", F.lit("")).alias("part"), F.greatest(F.coalesce("p.n", F.lit(1)), F.lit(0)).cast("bigint").alias("n"), "built_at")
    order = [F.col("salt"), F.col("head").desc(), F.col("record"), F.col("part"), F.col("built_at").desc_nulls_last(), F.col("n").desc()]
    routed = one.repartition("head", "salt").sortWithinPartitions(*order).select("head", "salt", "record", "part", "n")
    parts = routed.mapInArrow(count_sorted, "terms array<string>, frequency bigint, n_records bigint")
    terms = parts.groupBy("terms").agg(F.sum("frequency").alias("frequency"), F.sum("n_records").alias("n_records"))
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") > common * F.col("all_records"), "common")
    return terms.crossJoin(F.broadcast(records)).select(F.col("terms")[0].alias("term"), "frequency", "n_records", mark.alias("mark"))  # records: one row


def record_terms(entries: DataFrame, key: str = "entry_no", fields: tuple[str, ...] = ("body", "section")) -> DataFrame:
    """(key, term, n, length): how often each term stands in a record, and how many terms it has.

    Rows of a record that are equal count once, others are added up. Terms are the longest runs of
    letters and digits of the consistent text, in the form of ``term_form``."""
    kind = entries.schema[key].dataType.simpleString()
    own = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*[F.coalesce(f, F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])).alias("texts"))
    own = own.select(key, F.flatten(F.transform("texts", lambda x: F.array(*[x[f"f{i}"] for i in range(len(fields))]))).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, held = b.column(0).to_pylist(), b.column(1).to_pylist()
            forms = iter(consistent([x for texts in held for x in texts]))
            k, term, n, length = [], [], [], []
            for key_, texts in zip(keys, held, strict=True):
                found = Counter(term_of(run) for _ in texts for run in RUN.findall(next(forms)))
                found.pop("", None)
                k += [key_] * len(found)
                term += found.keys()
                n += found.values()
                length += [sum(found.values())] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(k, b.column(0).type), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(length, pa.int64())], names=[key, "term", "n", "length"])

    return own.mapInArrow(run, f"`{key}` {kind}, term string, n bigint, length bigint")


#: The weight of the collection's distribution, in terms.
PRIOR = 500.0


def log_odds(counts: DataFrame, key: str = "entry_no", prior: float = PRIOR, hot_terms: int = 4000) -> DataFrame:
    """(key, term, n, total, z, length, all_n) for rows (key, term, n, length); all_n is the number of all terms.

    ``prior`` is the weight of the collection's distribution, in terms. Totals are aggregated before
    the shuffle. The join of totals with rows is split: terms with more than 1 in ``hot_terms`` of all
    rows, of which there are fewer than ``hot_terms``, are broadcast; the rest, none of which is hot, is
    joined by shuffle."""
    counts = materialize(counts, "terms")
    sums = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("all_rows"))
    totals = materialize(counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("held")), "totals").crossJoin(F.broadcast(sums))
    hot = F.col("held") * hot_terms > F.col("all_rows")
    few = F.broadcast(totals.where(hot).select("term", "total", "all_n"))
    rest = totals.where(~hot).select("term", "total", "all_n")
    joined = counts.join(few, "term").unionByName(counts.join(few, "term", "left_anti").join(rest, "term"))
    return joined.select(key, "term", "n", "total", z_score(F.col("n"), F.col("total"), F.col("length"), F.col("all_n"), prior).alias("z"), "length", "all_n")


def z_score(n: Column, total: Column, length: Column, all_n: Column, prior: float) -> Column:
    """The z-score of a term that a record of ``length`` terms has ``n`` times, the collection ``total`` times."""
    share = total / all_n * prior
    in_record = n + share
    elsewhere = total - n + share
    floor = F.lit(1e-9)
    odds = F.log(in_record / F.greatest(length + prior - in_record, floor)) - F.log(elsewhere / F.greatest(all_n - length + prior - elsewhere, floor))
    return odds / F.sqrt(1 / in_record + 1 / elsewhere)


def own_terms(scores: DataFrame, least: int = 3, share: float = 0.25, prior: float = PRIOR, key: str = "entry_no") -> DataFrame:
    """(key, term) of scored terms that occur at least ``least`` times in the record, where these are at
    least ``share`` of all occurrences.

    The score selects: a term that has n of its occurrences in a record can have n to n / share in all, so
    the least score that these give is a bound below which no such term is. Terms under it are dropped, and
    what is left is tested exactly."""
    every = F.sequence(F.col("n"), F.floor(F.col("n") / share))
    bound = F.array_min(F.transform(every, lambda t: z_score(F.col("n"), t, F.col("length"), F.col("all_n"), prior)))
    found = scores.where(F.col("n") >= least).where(F.col("z") >= bound - 1e-6)
    return found.where(F.col("n") >= share * F.col("total")).select(key, "term")
