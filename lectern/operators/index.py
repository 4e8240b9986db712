"""Inverted index, ranked search, alias and relationship expansion, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.versions import Overtaken, Store
from lectern.session import materialize

# Weights of the ranking.
WEIGHTS = {"name": 4.0, "body": 2.0, "section": 1.5, "metadata": 0.5}
ALIAS_FACTOR, PHRASE_BONUS, HOP_DECAY, DIGITS = 0.3, 5.0, 0.25, 5
#: Up to so many terms of names that a query stands for are broadcast; more are joined by a shuffle.
MOST_TERMS = 10_000


def field_tokens(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term), one row per token. All fields go through the tokenizer in one pass."""
    found = docs.select(key, *[tx.index_tokens(F.col(f)).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in fields])
    return found.select(key, F.inline(pairs)).select(key, "field", F.explode("terms").alias("term"))


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term, tf): the index in long form; counts are combined before the shuffle."""
    return field_tokens(docs, key, fields).groupBy(key, "field", "term").agg(F.count("*").alias("tf"))


def doc_frequency(index: DataFrame, key: str) -> DataFrame:
    """(term, df): records with the term in any field."""
    return index.select(key, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def posting_lists(index: DataFrame, key: str) -> DataFrame:
    """(term, df, tf): records and occurrences per term, the header of its list. The list itself stays in
    long form, clustered by term; one row with all records of a frequent term would not scale."""
    return index.groupBy("term").agg(F.count_distinct(F.col(key)).alias("df"), F.sum("tf").alias("tf"))


def posting_blocks(index: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """(term, block, postings): the index with the records of a term in blocks, each an array of (key, field,
    tf) in order. A frequent term has as many blocks as its records need, so no row holds more than about
    ``size`` of them; blocks are made by a hash of the record, as many as the count of the term asks for."""
    blocks = index.groupBy("term").agg(F.ceil(F.count("*") / size).alias("blocks"))
    placed = index.join(blocks, "term").withColumn("block", F.pmod(F.xxhash64(F.col(key)), F.col("blocks")))
    return placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct(key, "field", "tf"))).alias("postings"))


def store_index(index: DataFrame, folder: str, key: str, parts: int = 64) -> None:
    """Write an index in long form, clustered by term: files of a part of the terms, sorted by term, so that a
    query reads a few row groups of the parts that its terms are in."""
    rows = index.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    rows.repartition("part").sortWithinPartitions("part", "term", key).write.mode("overwrite").partitionBy("part").parquet(folder)


def stored_postings(spark: SparkSession, folder: str, terms: list[str], parts: int = 64) -> DataFrame:
    """Postings of some terms of a stored index; other parts aren't read."""
    rows = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    at = [r[0] for r in rows.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).distinct().collect()]
    return spark.read.parquet(folder).where(F.col("part").isin(*at) & F.col("term").isin(*set(terms))).drop("part")


def ensure_index(docs: DataFrame, folder: str, signature: str, key: str, fields: list[str]) -> str:
    """The folder of a stored index of documents whose state has this signature. It is made again if there is none
    for the signature; one that wasn't finished doesn't count."""
    store = Store(docs.sparkSession, folder)
    if f"{signature}.json" not in store.names("valid"):
        store_index(postings(docs, key, fields), f"{folder}/{signature}", key)
        try:
            store.publish(f"valid/{signature}.json", "{}")
        except Overtaken:  # another writer has finished the same index
            pass
    return f"{folder}/{signature}"


def hits(found: DataFrame, docs: DataFrame, key: str = "id", size: int = 500) -> DataFrame:
    """Found rows (key, score, matches, ...) with what a result shows: type, kind, sources, section, locator,
    review status, the first ``size`` characters of the body and whether there are more."""
    shown = [c for c in ("type", "kind", "source_ids", "section", "locator", "review_status") if c in docs.columns]
    return found.join(docs.select(key, *shown, *tx.snippet(F.coalesce("body", F.lit("")), size)), key)


def eligible(docs: DataFrame, source: str | None = None, section: str | None = None, kind: str | None = None) -> DataFrame:
    """Records that a query may return: of a source, with a section that contains a text, of a kind."""
    if source is not None:
        docs = docs.where(F.array_contains("source_ids", source))
    if section is not None:
        docs = docs.where(F.lower(F.coalesce("section", F.lit(""))).contains(section.casefold()))
    if kind is not None:
        docs = docs.where(F.col("kind") == kind)
    return docs


def search(docs: DataFrame, term: str, key: str = "id", fields: tuple[str, ...] = ("name", "body", "section"), names: DataFrame | None = None, edges: DataFrame | None = None, allowed: DataFrame | None = None, hubs: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(key, score, matches) of the records that match a term, unordered; with edges or hubs also via, the record
    that led to one.

    Every record counts for the frequencies, those in ``allowed`` (default all) can be found. ``names``
    (id, name) gives the name and aliases of knowledge: where one equals the term, the tokens of the
    others join the query at a lower weight. ``edges`` (a, b) leads on from what was found, one hop. ``index``
    (key, field, term, tf) are the postings of the records, as ``postings`` makes and ``store_index`` keeps them;
    with them no text is tokenized, and only texts of records that have a term are looked at."""
    spark: SparkSession = docs.sparkSession
    wanted = tx.token_list(term, indexing=False)
    phrase = tx.normal(term)
    terms, few = spark.createDataFrame([(t, 1.0) for t in sorted(set(wanted))], "term string, factor double"), True
    if names is not None:
        same = names.where(tx.normal_form(F.col("name")) == phrase).select("id").distinct()
        more = names.join(same, "id", "left_semi").select(F.explode(tx.query_tokens(F.col("name"))).alias("term")).distinct()
        more = materialize(more.join(F.broadcast(terms), "term", "left_anti"), "aliases")
        terms = terms.unionByName(more.withColumn("factor", F.lit(ALIAS_FACTOR)))
        few = more.limit(MOST_TERMS).count() < MOST_TERMS
    small = F.broadcast if few else (lambda x: x)  # terms of the query, and those of the names it stands for
    # one pass over the records: tokens, and whether the phrase occurs; what the query touches is written once
    # and small against the records, everything after reads only that
    holds = F.lit(False)
    if phrase:
        for f in ("name", "body"):
            if f in fields:
                holds = holds | F.coalesce(tx.normal_form(F.col(f)).contains(phrase), F.lit(False))
    if index is not None:
        rows = index.join(small(terms), "term").where(F.col("field").isin(*fields))
        said = docs.join(rows.select(key).distinct(), key, "left_semi").select(key, holds.alias("phrase"))
        hits = materialize(rows.join(said, key).select(key, "phrase", "field", "term", "factor", "tf"), "hits")
    else:
        rows = docs.select(key, *[tx.index_tokens(F.col(f)).alias(f) for f in fields], holds.alias("phrase"))
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in fields])
        rows = rows.select(key, "phrase", F.inline(pairs)).select(key, "phrase", "field", F.explode("terms").alias("term"))
        hits = materialize(rows.join(small(terms), "term").groupBy(key, "phrase", "field", "term", "factor").agg(F.count("*").alias("tf")), "hits")
    df = hits.select(key, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    idf = F.log(1 + (F.col("total") + 1) / (F.col("df") + 1))
    part = F.col("factor") * weight[F.col("field")] * idf * (1 + F.log("tf"))
    scored = hits.join(small(df), "term").crossJoin(F.broadcast(total))  # total: one row
    if allowed is not None:
        scored = scored.join(allowed.select(key).distinct(), key, "left_semi")
    bonus = F.when(F.bool_or("phrase"), PHRASE_BONUS).otherwise(0.0)
    scored = scored.groupBy(key).agg((F.sum(part) + bonus).alias("score"), F.array_sort(F.collect_set(F.concat_ws(":", "term", "field"))).alias("matches"))
    columns = [key, F.round("score", DIGITS).alias("score"), "matches"]
    if edges is not None:
        from lectern.operators.graph import neighbours

        scored = materialize(scored, "scored")
        near = neighbours(scored, edges, hubs, key).withColumn("score", F.col("score") * HOP_DECAY)
        pool = (allowed if allowed is not None else docs).select(key).distinct()
        near = near.join(pool, key, "left_semi").join(scored.select(key), key, "left_anti")
        columns.append("via")
        via = F.lit(None).cast(docs.schema[key].dataType).alias("via")
        scored = scored.select("*", via).unionByName(near.select(key, "score", F.array().cast("array<string>").alias("matches"), "via"))
    return scored.select(*columns)


def page(found: DataFrame, key: str, limit: int = 12, offset: int = 0) -> DataFrame:
    """One page of results by score, then id, with the number of all and the next offset (null at the end).

    Only the first offset + limit rows are sorted out of each task; the total is a separate count."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    total = found.agg(F.count("*").alias("total_hits"))
    rows = found.orderBy(F.col("score").desc(), F.col(key)).offset(offset).limit(limit)
    following = F.when(F.col("total_hits") > offset + limit, F.lit(offset + limit))
    return rows.crossJoin(F.broadcast(total)).withColumn("next_offset", following)  # total: one row


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, reason) in both directions, without loops, each once."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "reason")
    return edges.select("a", "b", "reason").unionByName(turned).where(F.col("a") != F.col("b")).distinct()


def substring_scan(parts: list[tuple[str, DataFrame]], term: str, size: int = 2000) -> DataFrame:
    """(origin, id, text) of texts that contain a term, regardless of case; texts cut to ``size``.

    parts: named frames of (id, text)."""
    out = None
    for origin, rows in parts:
        hit = rows.where(F.lower("text").contains(term.lower())).select(F.lit(origin).alias("origin"), F.col("id").cast("string").alias("id"), F.substring("text", 1, size).alias("text"))
        out = hit if out is None else out.unionByName(hit)
    return out


def first_wins(rows: DataFrame, content: Column, order: list[str], name: str) -> DataFrame:
    """The first row of each content, with the names of later ones in order.

    Rows of one content may be many: they are combined before the shuffle into the least row and the
    set of names."""
    least = F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("first")
    grouped = rows.withColumn("content", content).groupBy("content").agg(least, F.array_sort(F.collect_set(name)).alias("names"))
    kept = grouped.select("content", *[F.col(f"first.`{c}`").alias(c) for c in rows.columns], "names")
    return kept.withColumn("duplicate_names", F.array_except("names", F.array(name))).drop("names")
