"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources with a target are a registry, held on the driver up to this bound.
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


#: Characters handed to the tokenizer at once, about; a longer text is cut where its own
#: pattern splits.
PIECE = 1 << 20
PRETOKEN = regex.compile(SPLIT)


def count_tokens(path: str, text: str, piece: int = PIECE) -> int:
    """Tokens of a text. A long one is cut only between matches of the splitting pattern,
    across which no merge goes, and not after white space, whose matches depend on what
    follows; a single match, however long, is never cut."""
    encode = tokenizer(path).encode_ordinary
    if len(text) <= piece:
        return len(encode(text))
    total = start = end = 0
    for match in PRETOKEN.finditer(text):
        if match.end() - start > piece and end > start:
            total += len(encode(text[start:end]))
            start = end
        if not text[match.end() - 1].isspace():
            end = match.end()
    return total + len(encode(text[start:]))


def source_name(source: Column) -> Column:
    """One name for the spellings of a source: lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document; null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [0 if t is None else count_tokens(vocabulary, t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), "text").mapInArrow(run, "doc_id long, source string, tokens long")


#: Rates above this give any document its most repeats.
TOP_RATE = 700.0
#: Rates are told apart by bins, each pass cuts one of them into so many.
BINS, PASSES = 256, 5


def critical_rates(number: np.ndarray, most: int) -> np.ndarray:
    """(documents, most): the rate from which on a document comes j or more times, j = 1...

    A document's count inverts the Poisson distribution at its number u: it is at least j
    where P(count < j) < u. That probability falls with the rate, so there is one rate for
    each j, found by bisection.
    """
    out = np.empty((len(number), most))
    low_all = np.zeros(len(number))
    for j in range(1, most + 1):
        low, high = low_all.copy(), np.full(len(number), TOP_RATE)
        for _ in range(52):
            rate = (low + high) / 2
            term = np.exp(-rate)
            below = term.copy()
            for i in range(1, j):
                term = term * rate / i
                below += term
            more = below < number
            high = np.where(more, rate, high)
            low = np.where(more, low, rate)
        out[:, j - 1] = high
        low_all = low
    return out


def goals_of(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Tokens each source is to give: its share of the mixture, at most its cap allows.

    Shares are taken of the sources that have tokens. Without `total_tokens` the mixture is
    the largest in which every one of them reaches its share within its cap, so the source
    that is scarcest for its share sets the size; with more asked for, sources that reach
    their cap fall short and the others still give their share of `total_tokens`.
    """
    live = {s: t for s, t in targets.items() if totals.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in live.values())
    if not live:
        return {}
    if total_tokens is None:
        total_tokens = min(t[1] * totals[s] * whole / t[0] for s, t in live.items())
    return {s: min(float(t[1] * totals[s]), total_tokens * t[0] / whole) for s, t in live.items()}


def _rates(steps: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """The rate of each source at which its documents' counts give its goal of tokens.

    steps: source, rate, tokens, one row for each time a document may come. The tokens drawn
    at a rate are those of the steps below it. The rate sought is bracketed by counts per
    bin, finer in each pass: BINS rows a source come to the driver, and every document
    counts in each. A document more or less is what a source then misses its goal by.
    """
    spark = steps.sparkSession
    low = {s: 0.0 for s in goals}
    high = {s: TOP_RATE for s in goals}
    base = {s: 0.0 for s in goals}  # tokens of the steps below `low`
    for _ in range(PASSES if goals else 0):
        bounds = F.broadcast(spark.createDataFrame([(s, low[s], high[s]) for s in goals], "source string, low double, high double"))
        inside = steps.join(bounds, "source").where("rate > low AND rate <= high")
        place = F.least(F.floor((F.col("rate") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)).cast("int")
        counts = {}
        for r in inside.groupBy("source", place.alias("bin")).agg(F.sum("tokens").alias("tokens")).collect():
            counts.setdefault(r[0], {})[r[1]] = r[2]
        for s, goal in goals.items():
            width, total = (high[s] - low[s]) / BINS, base[s]
            for i, tokens in sorted(counts.get(s, {}).items()):
                if total + tokens > goal:
                    base[s], low[s], high[s] = total, low[s] + i * width, low[s] + (i + 1) * width
                    break
                total += tokens
            else:  # all of it is wanted
                base[s], low[s] = total, high[s]
    # Of the two ends of the last bracket the one that comes nearer to the goal.
    upper = {}
    if goals:
        bounds = F.broadcast(spark.createDataFrame([(s, low[s], high[s]) for s in goals], "source string, low double, high double"))
        for r in steps.join(bounds, "source").where("rate > low AND rate <= high").groupBy("source").agg(F.sum("tokens")).collect():
            upper[r[0]] = r[1]
    return {s: high[s] if abs(base[s] + upper.get(s, 0) - g) < abs(base[s] - g) else low[s] for s, g in goals.items()}


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 9, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report). rows: doc_id, source, copy, tokens, place; report: one row a source.

    documents: doc_id, text, source; targets: source, target_share, max_repeats. Spellings
    of a source are one; of targets of one source the greatest row counts. Sources without
    a target take no part and are reported with null target; sources with a target but
    without tokens are reported with nothing used, and the other shares are taken of what
    remains. Null and empty texts have no tokens and are never repeated. Repeated rows of
    one doc_id are repeated alike. Size without `total_tokens`: see goals_of.

    A document's count inverts a Poisson distribution of its source's rate, held to
    max_repeats, at a number hashed from seed and doc_id. Counts grow with the rate, so the
    rate is set to where the documents' counts really give the source its tokens, not only
    in the mean: shares are right to a document. `place` orders the mixture at random over
    all sources; the rows come range-partitioned and sorted by it.
    """
    wanted = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    targets_ = {r[0]: (float(r[1] or 0.0), int(r[2] or 0)) for r in wanted}
    spark = documents.sparkSession
    sized = materialize(sizes(documents, vocabulary))
    held = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    totals = {r[0]: r[1] for r in held.where(F.col("source").isin([*targets_])).select("source", "tokens").collect()} if targets_ else {}
    goals = goals_of(totals, targets_, total_tokens)
    number = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    caps = F.broadcast(spark.createDataFrame([(s, targets_[s][1]) for s in goals], "source string, most int"))
    drawn = materialize(sized.where("tokens > 0").join(caps, "source").withColumn("number", number).mapInArrow(_steps, "doc_id long, source string, tokens long, steps array<double>"))
    rates = _rates(drawn.select("source", F.explode("steps").alias("rate"), "tokens"), goals)
    table = F.broadcast(spark.createDataFrame([*rates.items()], "source string, chosen double"))
    drawn = drawn.join(table, "source").withColumn("n", F.size(F.filter("steps", lambda p: p <= F.col("chosen"))))
    rows = drawn.where("n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")
    rows = rows.select("doc_id", "source", F.col("copy").cast("long"), "tokens", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("place"))
    used = drawn.groupBy("source").agg(F.sum("n").alias("used_documents"), F.sum(F.col("n") * F.col("tokens")).alias("used_tokens"), F.max("n").cast("long").alias("most_repeats"))
    goal = spark.createDataFrame([(s, t, m, goals[s] / totals[s] if s in goals else 0.0) for s, (t, m) in targets_.items()], "source string, target_share double, max_repeats long, mean_repeats double")
    both = held.join(goal, "source", "full").join(used, "source", "left").fillna(0, ["documents", "tokens", "used_documents", "used_tokens", "most_repeats", "mean_repeats"])
    whole = used.agg(F.sum("used_tokens").alias("all_tokens"))
    report = both.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", "documents", "tokens", "mean_repeats", "used_documents", "used_tokens", "most_repeats", F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    return rows.repartitionByRange("place").sortWithinPartitions("place"), report


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The critical rates of each document, as many as its source's most repeats."""
    for batch in batches:
        number, most = batch["number"].to_numpy(), batch["most"].to_numpy()
        steps = [None] * batch.num_rows
        for m in np.unique(most):
            rows = np.flatnonzero(most == m)
            for i, r in zip(rows, critical_rates(number[rows], int(m))):
                steps[i] = r
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["tokens"], pa.array(steps, pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "steps"])
