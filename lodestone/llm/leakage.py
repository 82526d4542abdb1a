"""Evaluation texts leaking into training text, by suffix arrays over training shards."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of the stated item set that one pass over the documents takes; more go in blocks.
BLOCK_WORDS = 2_000_000
#: Words of training text in one suffix array.
SHARD_WORDS = 1 << 20


def words(text: str) -> list[str]:
    """NFKC, characters of category Cf dropped, lower case; runs of letters and digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join([c for c in text if unicodedata.category(c) != "Cf"]) if not text.isascii() else text
    return WORD.findall(text.lower())


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes in order of their first `depth` tokens or more, by prefix
    doubling: after each step ranks stand for twice as many tokens."""
    _, rank = np.unique(tokens, return_inverse=True)
    reach = 1
    while reach < depth:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: len(rank) - reach] = rank[reach:]
        key = rank.astype(np.int64) * (len(rank) + 2) + ahead + 1
        _, rank = np.unique(key, return_inverse=True)
        reach *= 2
    return np.argsort(rank, kind="stable")


def _bounds(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the suffixes that start with each query (rows), by binary search."""
    n, m = queries.shape
    found = []
    for upper in (False, True):
        low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            seen = tokens[order[mid][:, None] + np.arange(m)]
            differ = seen != queries[open_]
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            below = seen[rows, first] < queries[open_, first]
            before = below & differ.any(1) | (upper & ~differ.any(1))
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        found.append(low)
    return found[0], found[1]


class Items:
    """The suffixes of the test items as numbered words, shipped to every task."""

    def __init__(self, rows: list[tuple[int, list[str]]], least: int):
        self.least = least
        rows = [(i, w) for i, w in rows if len(w) >= least]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in rows for x in ws}))}
        flat, start, item = [], [], []
        for k, (_, ws) in enumerate(rows):
            start += range(len(flat), len(flat) + len(ws) - least + 1)
            item += [k] * (len(ws) - least + 1)
            flat += [self.number[w] for w in ws] + [0]
        # Padding lets every comparison run past the end; 0 matches nothing.
        self.flat = np.array(flat + [0] * (least + 1), np.int64)
        self.start, self.item = np.array(start, np.int64), np.array(item, np.int64)

    def matches(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, position in the shard, position in the item's suffixes, length) of the
        longest verbatim matches that cannot be extended to the left."""
        tokens = np.concatenate([shard, np.full(self.least + 1, -1)])
        order = suffix_array(shard, self.least)
        low, high = _bounds(tokens, order, self.flat[self.start[:, None] + np.arange(self.least)])
        out = []
        hit = np.flatnonzero(high > low)
        for part in np.array_split(hit, max(1, int((high - low)[hit].sum()) >> 20)):
            count = (high - low)[part]
            suffix = np.repeat(part, count)
            at = order[np.repeat(low[part] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            here = self.start[suffix]
            # A match whose words before also agree is part of a longer one.
            new = (at == 0) | (here == 0) | (tokens[at - 1] != self.flat[here - 1]) | (self.flat[here - 1] == 0)
            suffix, at, here = suffix[new], at[new], here[new]
            length = np.full(len(at), self.least)
            grow = np.arange(len(at))
            while len(grow):
                a, b = tokens[at[grow] + length[grow]], self.flat[here[grow] + length[grow]]
                grow = grow[(a == b) & (b > 0)]
                length[grow] += 1
            out.append((self.item[suffix], at, here, length))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int),) * 4


MATCH = "item_id long, doc_id long, words long, doc_word long"


def leaks(documents: DataFrame, items: DataFrame, least: int = 13) -> DataFrame:
    """(item_id, doc_id, words, doc_word): the longest verbatim match of each item in each
    document that has one of `least` consecutive words or more, and where it starts.

    documents: doc_id, text; items: item_id, text; other columns are ignored. Null texts
    and ids are left out, items of fewer than `least` words match nothing, texts are used
    whole, repeated rows change nothing. Ties of length go to the first place.

    Every task builds suffix arrays over its own shard of the documents (SHARD_WORDS words
    each; a longer document is a shard of its own) and finds all suffixes of all items in
    them by binary search; nothing of the corpus is shuffled but matches. The items are a
    stated set: they travel to all tasks in blocks of BLOCK_WORDS words.
    """
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    block: list[tuple[int, list[str]]] = []
    held, out = 0, None
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id").toLocalIterator():
        block.append((row[0], words(row[1])))
        held += len(block[-1][1])
        if held >= BLOCK_WORDS:
            found = _search(texts, Items(block, least))
            out, block, held = (found if out is None else out.union(found)), [], 0
    if block or out is None:
        found = _search(texts, Items(block, least))
        out = found if out is None else out.union(found)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("at"))).alias("b")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", F.col("b.words").alias("words"), (-F.col("b.at")).alias("doc_word"))


def _search(texts: DataFrame, items: Items) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words

    def shard(docs: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        it = shared.value
        sizes = np.array([len(t) + 1 for _, t in docs])
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(sizes.sum(), np.int64)
        for at, (_, t) in zip(starts, docs):
            flat[at : at + len(t)] = t
        item, at, _, length = it.matches(flat)
        doc = np.searchsorted(starts, at, "right") - 1
        ids = np.array([i for i, _ in docs], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(it.ids[item] if len(item) else np.empty(0, np.int64)), pa.array(ids[doc]), pa.array(length.astype(np.int64)), pa.array((at - starts[doc]).astype(np.int64))], names=["item_id", "doc_id", "words", "doc_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number.get
        if not len(shared.value.start):
            return
        docs, held = [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                tokens = np.array([number(w, 0) for w in words(text)], np.int64)
                if len(tokens) < shared.value.least:
                    continue
                docs.append((i, tokens))
                held += len(tokens)
                if held >= SHARD_WORDS:
                    yield shard(docs)
                    docs, held = [], 0
        if docs:
            yield shard(docs)

    return texts.mapInArrow(run, MATCH)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold none of the items."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
