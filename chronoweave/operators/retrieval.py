"""Hybrid recall: channels of candidate facts, rank fusion, reranking and evidence packs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import fact_text, has_all_words, query_names, trigram_similarity, words
from chronoweave.functions.vectors import cosine, usable
from chronoweave.operators.graph import paths
from chronoweave.session import checkpointed

RRF_K = 60


def ranked(candidates: DataFrame, channel: str, *order: Column, limit: int = 40) -> DataFrame:
    """``fact_id``, ``channel``, ``rank``: the first ``limit`` candidates by a total order (a top-k, not a full sort)."""
    top = candidates.orderBy(*order, "fact_id").limit(limit)  # so few rows that one task may number them
    return top.select("fact_id", F.lit(channel).alias("channel"), F.row_number().over(Window.orderBy(*order, "fact_id")).alias("rank"))


def touching(facts: DataFrame, near: DataFrame) -> DataFrame:
    """Facts with an entity of ``near`` (entity_id, distance) as subject or object, and the least distance. Two equi-joins
    and a union instead of a join on either of two columns."""
    sides = [facts.join(near.withColumnRenamed("entity_id", c), c).select("fact_id", "distance") for c in ("subject_id", "object_entity_id")]
    return sides[0].unionByName(sides[1]).groupBy("fact_id").agg(F.min("distance").alias("distance"))


def nearest_entities(entities: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k live entities nearest to a query vector: ``entity_id``, ``distance`` (1 - cosine, 6 decimals)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = entities.filter(F.col("merged_into").isNull() & usable("embedding", len(query)))
    return rows.select("entity_id", F.round(1 - cosine(F.col("embedding"), q), 6).alias("distance")).orderBy("distance", "entity_id").limit(k)


def vector_channel(facts: DataFrame, entities: DataFrame, query: list[float], k: int = 5, limit: int = 40) -> DataFrame:
    return ranked(touching(facts, nearest_entities(entities, query, k)), "vector", F.col("distance"), limit=limit)


def bm25(documents: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key``, ``score`` of documents with a word of the query. Document counts and lengths are over all documents.

    Each text is read for its words once, for its length and the frequencies of the query's words; what is kept of it
    (as many numbers as the query has words) is written, and totals and scores are made of that.
    """
    asked = [r[0] for r in documents.sparkSession.range(1).select(F.explode(F.array_distinct(words(F.lit(query))))).collect()]  # the query's words
    if not asked:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    frequency = lambda q: F.size(F.filter("__w", lambda w: w == F.lit(q)))
    read = documents.select(key, words(text).alias("__w")).select(key, F.size("__w").alias("len"), *[frequency(q).alias(f"tf{i}") for i, q in enumerate(asked)])
    read = checkpointed(read)
    total = read.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    score, hit = F.lit(0.0), F.lit(False)
    for i in range(len(asked)):
        tf, idf = F.col(f"tf{i}"), math.log(1 + (total["n"] - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (total["mean"] or 1.0)))
        hit = hit | (tf > 0)
    return read.filter(hit).select(key, score.alias("score"))


def lexical_channel(named: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """Facts (with names) that have all words of the query or contain it as text, by BM25."""
    text = named.withColumn("__t", fact_text())
    hit = text.filter(has_all_words("__t", F.lit(query)) | F.contains(F.lower("__t"), F.lit(query.lower())))
    score = bm25(text, "fact_id", "__t", query)
    return ranked(hit.select("fact_id").join(score, "fact_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)), "lexical", F.desc("score"), limit=limit)


def graph_channel(graph: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 40) -> DataFrame:
    found = paths(graph, seeds, hops).groupBy("fact_id").agg(F.min("hop").alias("hop"))
    return ranked(found, "graph", F.col("hop"), limit=limit)


def synonym_channel(named: DataFrame, synonyms: DataFrame, query: str, limit: int = 40, mode: str = "any") -> DataFrame:
    """Facts that match the query with synonyms: each word may be replaced by one of its aliases (``any``), or all words
    and aliases must occur (``all``). No rows if no word has a synonym."""
    asked = synonyms.select(F.explode(F.array_distinct(words(F.lit(query)))).alias("q")).distinct()
    known = synonyms.select(F.lower("term").alias("q"), F.explode("aliases").alias("alias"))
    options = asked.join(known, "q", "left").groupBy("q").agg(F.array_union(F.array("q"), F.transform(F.collect_set("alias"), lambda a: F.lower(a))).alias("options"))
    groups = options.agg(F.collect_list("options").alias("groups"))  # one row: the query's words
    text = named.select("fact_id", words(fact_text()).alias("w")).crossJoin(F.broadcast(groups)).filter(F.exists("groups", lambda g: F.size(g) > 1))
    if mode == "all":
        hit = text.filter(F.forall("groups", lambda g: F.forall(g, lambda x: F.array_contains("w", x))))
    else:
        hit = text.filter(F.forall("groups", lambda g: F.arrays_overlap(F.col("w"), g)))
    return ranked(hit, "synonym", F.col("fact_id"), limit=limit)


def name_channel(facts: DataFrame, entities: DataFrame, aliases: DataFrame, question: str, per_name: int = 5, limit: int = 40) -> DataFrame:
    """Facts of entities whose name or alias contains, or by trigrams resembles, a name in the question."""
    names = entities.select("entity_id", F.col("canonical_name").alias("name")).unionByName(aliases.select("entity_id", F.col("alias").alias("name")).join(entities.select("entity_id"), "entity_id", "left_semi"))
    asked = names.withColumn("asked", F.explode(query_names(F.lit(question))))
    similar = F.round(trigram_similarity("name", "asked"), 6)
    hit = asked.withColumn("sim", similar).filter(F.contains(F.lower("name"), F.lower("asked")) | (F.col("sim") > 0.3))
    best = hit.groupBy("asked", "entity_id").agg(F.max("sim").alias("sim"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("sim"), "entity_id"))).filter(F.col("r") <= per_name)
    near = top.groupBy("entity_id").agg(F.min(1 - F.col("sim")).alias("distance"))
    return ranked(touching(facts, near), "name", F.round("distance", 6), limit=limit)


def recency_channel(facts: DataFrame, anchor: str, days: int = 30, limit: int = 40) -> DataFrame:
    rows = facts.filter(F.col("valid_from") >= F.lit(anchor).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return ranked(rows, "recency", F.desc("valid_from"), limit=limit)


def fuse(channels: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: ``fact_id``, ``score``, ``n_channels``."""
    every = reduce(DataFrame.unionByName, channels)
    return every.groupBy("fact_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("n_channels"))


def best_ranks(channels: list[DataFrame]) -> DataFrame:
    """``fact_id``, ``rank``: each fact once, at its best rank in any of the lists (several forms of one question)."""
    return reduce(DataFrame.unionByName, channels).groupBy("fact_id").agg(F.min("rank").alias("rank"))


def salience(facts: DataFrame, events: DataFrame, weight: float = 1.0) -> DataFrame:
    """``fact_id``, ``bonus``: weight times a tenth of the largest access_count of the supporting events."""
    links = facts.select("fact_id", F.explode("supports").alias("event_id")).join(events.select("event_id", "access_count"), "event_id")
    return links.groupBy("fact_id").agg(F.round(weight * F.max("access_count") / 10, 6).alias("bonus"))


#: Words that ask back in time (fixed values).
BACK = ("last", "previous", "earlier", "before", "yesterday", "history")


def question_type(question: Column | str) -> Column:
    """multi for questions that ask back in time or have at least eight blanks, else single."""
    asked = F.lower(question)
    back = reduce(lambda a, b: a | b, (F.contains(asked, F.lit(w)) for w in BACK))
    return F.when(back | (F.length(asked) - F.length(F.replace(asked, F.lit(" "), F.lit(""))) >= 8), "multi").otherwise("single")


def route_limit(query: str) -> int:
    """Rows of each channel and of the reranker for a question: 160 for a multi question, else 40."""
    return 160 if any(w in query.lower() for w in BACK) or query.count(" ") >= 8 else 40


def overlap_score(text: Column | str, query: str) -> Column:
    """Share of the query's words in a text: the deterministic stand-in for a cross-encoder."""
    asked = F.array_distinct(words(F.lit(query)))
    return F.round(F.size(F.array_intersect(asked, words(text))) / F.greatest(F.lit(1), F.size(asked)), 6)


def rerank(named: DataFrame, fused: DataFrame, query: str, top: int = 25, least: float = 0.1, fallback: int = 10, candidates: int = 160) -> DataFrame:
    """The first ``candidates`` fused facts by relevance: at most ``top`` of at least ``least``; if there are none the first
    ``fallback`` by score."""
    rows = named.join(fused, "fact_id").withColumn("relevance", overlap_score(fact_text(), query))
    first = rows.orderBy(F.desc("score"), "fact_id").limit(candidates)
    good = first.filter(F.col("relevance") >= least)
    w, u = Window.orderBy(F.desc("relevance"), F.desc("score"), "fact_id"), Window.orderBy(F.desc("score"), "fact_id")
    marked = first.withColumn("__good", F.max((F.col("relevance") >= least).cast("int")).over(Window.partitionBy())).withColumn("__r", F.row_number().over(u))
    lone = marked.filter((F.col("__good") == 0) & (F.col("__r") <= fallback)).withColumn("rank", F.col("__r")).drop("__good", "__r")
    return good.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).unionByName(lone)


def within_budget(items: DataFrame, order: list[str], tokens: str, budget: int, keys: list[str] | None = None) -> DataFrame:
    """The first items, per key, whose tokens (at least 1 each) fit the budget; the first one always.

    No more items than the budget has tokens can fit, so a row_number limit, which is applied before the shuffle, leaves
    a bounded number per key for the running sum. ``order`` must be total.
    """
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    few = items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, budget))
    summed = few.withColumn("used", F.sum(tokens).over(Window.partitionBy(*(keys or [])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return summed.filter((F.col("rank") == 1) | (F.col("used") <= budget))


def recall(
    facts: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    graph: DataFrame,
    named: DataFrame,
    query: str,
    vector: list[float],
    anchor: str,
    limit: int | None = None,
    top: int = 25,
    synonyms: DataFrame | None = None,
    bonus: DataFrame | None = None,
) -> DataFrame:
    """The evidence for a query: six channels, fused and reranked, ``rank`` from 1. One plan, one action.

    ``limit`` rows (by default as the question is routed) of each channel and of the fused facts. ``synonyms`` (term,
    aliases) make the synonym channel; ``bonus`` (fact_id, bonus; see ``salience``) is added to the fused scores.
    """
    limit = route_limit(query) if limit is None else limit
    seeds = nearest_entities(entities, vector).select(F.col("entity_id").alias("seed"))
    channels = [
        vector_channel(facts, entities, vector, limit, limit),
        lexical_channel(named, query, limit),
        graph_channel(graph, seeds, 2, limit),
        name_channel(facts, entities, aliases, query, limit=limit),
        recency_channel(facts, anchor, limit=limit),
    ]
    if synonyms is not None:
        channels.append(synonym_channel(named, synonyms, query, limit))
    fused = fuse(channels)
    if bonus is not None:
        fused = fused.join(bonus, "fact_id", "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    return rerank(named, fused, query, top, candidates=limit)
