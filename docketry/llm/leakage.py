"""Evaluation passages inside a training corpus (problem 7).

The test items form a BM25 inverted index whose terms are character grams of the compact text
(lower case, letters and digits only), so spacing and punctuation don't matter. Every passage of the
corpus queries it by block-max WAND; all items above a threshold are retrieved and verified.

The threshold loses nothing: an item and a passage that share a run of ``min_run`` characters share
the ``min_run - gram + 1`` consecutive grams of that run, so the passage's score for the item is at
least the smallest score of any such window of the item. Scores are divided by that bound per item;
the common threshold is then 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 8
MIN_RUN = 60
PASSAGE = 512
K1, B = 1.2, 0.75
BLOCK = 32
#: Items are indexed in blocks that end with the item that reaches this many compact characters, one block per
#: broadcast; such an index takes less than 300 MB of a worker, while it is built and with all items verified.
BLOCK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def compact(col: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{Nd}]+", "")


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram starting at each position (uint64 polynomial, mixed)."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * _BASE + wide[j : j + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least_window(text: str, score: np.ndarray, window: int) -> float:
    """Least sum of the scores of the distinct grams in ``window`` consecutive ones. ``score`` is by sorted gram."""
    g = gram_hashes(_codes(text))
    at = np.unique(g, return_inverse=True)[1]
    s = score[at]
    total = np.append(0.0, np.cumsum(s))
    sums = total[window:] - total[:-window]
    # A gram counts once in a window: it is taken off where an earlier one stands in the same window.
    order = np.argsort(at, kind="stable")
    again = np.flatnonzero(at[order][1:] == at[order][:-1])
    before, here = order[again], order[again + 1]
    near = here - before < window
    before, here = before[near], here[near]
    off = np.zeros(len(sums) + 1)
    np.add.at(off, np.maximum(0, here - window + 1), -s[here])
    np.add.at(off, np.minimum(before + 1, len(sums)), s[here])
    return float((sums + np.cumsum(off)[:-1]).min()) * (1 - 1e-9)


class ItemIndex:
    """BM25 index of the items with per-block score bounds, as flat arrays."""

    def __init__(self, ids: list[int], texts: list[str], min_run: int = MIN_RUN):
        kept = [(i, t) for i, t in zip(ids, texts) if len(t) >= min_run]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.min_run = min_run
        self.runs: dict[int, np.ndarray] = {}
        size = np.array([len(t) - GRAM + 1 for t in self.texts], float)
        n = max(1, len(size))
        mean = size.sum() / n
        terms, owner, tf = np.empty(int(size.sum()), np.uint64), np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.int32)
        own = np.zeros(len(size) + 1, np.int64)
        for k, t in enumerate(self.texts):
            u, c = np.unique(gram_hashes(_codes(t)), return_counts=True)
            a, b = own[k], own[k] + len(u)
            terms[a:b], owner[a:b], tf[a:b], own[k + 1] = u, k, c, b
        terms, owner, tf = terms[: own[-1]], owner[: own[-1]], tf[: own[-1]]
        order = np.argsort(terms, kind="stable").astype(np.int32)
        terms, owner, tf = terms[order], owner[order], tf[order]
        fresh = np.ones(len(terms), bool)
        fresh[1:] = terms[1:] != terms[:-1]
        self.start = np.append(np.flatnonzero(fresh), len(terms)).astype(np.int32)
        self.terms = terms[fresh]
        df = np.diff(self.start)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(mean, 1)) if len(size) else size
        score = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[owner]) if len(tf) else np.empty(0)
        # The least score that a shared run gives, per item.
        by_item = np.empty(len(score))
        by_item[order] = score
        bound = np.array([_least_window(t, by_item[own[k] : own[k + 1]], min_run - GRAM + 1) for k, t in enumerate(self.texts)])
        self.item, self.score = owner, score / bound[owner] if len(tf) else score
        blocks = -(-df // BLOCK)
        self.block_of = np.append(0, np.cumsum(blocks)).astype(np.int32)
        place = np.arange(self.block_of[-1]) - np.repeat(self.block_of[:-1], blocks)
        starts = np.repeat(self.start[:-1], blocks) + place * BLOCK
        self.block_max = np.maximum.reduceat(self.score, starts) if len(starts) else np.empty(0)
        self.term_max = np.maximum.reduceat(self.score, self.start[:-1]) if len(df) else np.empty(0)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram is a term, and the term's number."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return np.empty(0, int), np.empty(0, int)
        found = np.searchsorted(self.terms, hashes[at])
        found[found == len(self.terms)] = 0
        good = self.terms[found] == hashes[at]
        return at[good], found[good]

    def retrieve(self, query: np.ndarray, threshold: float = 1.0) -> list[int]:
        """All items whose score for the distinct term numbers ``query`` reaches the threshold.

        Block-max WAND: cursors are kept by item; the first prefix of cursors whose term bounds reach
        the threshold gives the pivot; the bounds of the blocks at the pivot decide if it is scored or
        skipped. A small slack covers rounding.
        """
        limit = threshold * (1 - 1e-9)
        if self.term_max[query].sum() < limit:
            return []
        item, score, out = self.item, self.score, []
        cursors = [[int(item[self.start[t]]), int(self.start[t]), int(self.start[t + 1]), int(t)] for t in query]

        def block(c) -> int:
            return self.block_of[c[3]] + (c[1] - self.start[c[3]]) // BLOCK

        def seek(c, target: int) -> None:
            c[1] += int(np.searchsorted(item[c[1] : c[2]], target))
            c[0] = int(item[c[1]]) if c[1] < c[2] else len(self.ids)

        end = len(self.ids)
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += self.term_max[c[3]]
                if total >= limit:
                    pivot = k
                    break
            if pivot is None:
                return out
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    seek(c, target)
            here = [c for c in cursors[: pivot + 1] if c[0] == target]
            moved = [c for c in cursors[: pivot + 1] if target <= c[0] < end]
            if sum(self.block_max[block(c)] for c in moved) >= limit:
                if sum(score[c[1]] for c in here) >= limit:
                    out.append(target)
                following = target + 1
            else:
                # No item before the end of the nearest block can reach the threshold.
                ends = [
                    int(item[min(self.start[c[3]] + ((c[1] - self.start[c[3]]) // BLOCK + 1) * BLOCK, c[2]) - 1]) + 1
                    for c in moved
                ]
                following = max(target + 1, min(ends + ([cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else [])))
            for c in cursors[: pivot + 1]:
                if c[0] < following:
                    seek(c, following)

    def shares_run(self, k: int, passage: str) -> bool:
        """Exact check: do item ``k`` and the passage share a run of ``min_run`` characters?"""
        n, text = self.min_run, self.texts[k]
        runs = self.runs.get(k)
        if runs is None:
            runs = self.runs[k] = np.unique(gram_hashes(_codes(text), n))
        here = gram_hashes(_codes(passage), n)
        at = np.minimum(np.searchsorted(runs, here), len(runs) - 1)
        return any(passage[i : i + n] in text for i in np.flatnonzero(runs[at] == here).tolist())


@lru_cache(maxsize=2)
def _index(ids: tuple, texts: tuple, min_run: int) -> ItemIndex:
    """The index of a block, built once per Python worker and used by all its tasks."""
    return ItemIndex(list(ids), list(texts), min_run)


def _search(index: ItemIndex, ids, texts) -> Iterator[tuple[int, int]]:
    """Leaks of one batch. Grams are hashed for the whole batch at once; texts don't run together."""
    step = PASSAGE - index.min_run + 1
    whole = "\0".join(texts)
    at, terms = index.known(gram_hashes(_codes(whole)))
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    lo, hi = np.searchsorted(at, begins), np.searchsorted(at, begins + lengths)
    for k in np.flatnonzero(hi > lo):
        pos, term = at[lo[k] : hi[k]] - begins[k], terms[lo[k] : hi[k]]
        found: set[int] = set()
        last = max(0, lengths[k] - index.min_run)
        # A run that begins at a position lies whole in the passage numbered position // step.
        for a in (np.unique(pos // step) * step).tolist():
            if a > last:
                continue
            inside = (pos >= a) & (pos <= a + PASSAGE - GRAM)
            for item in index.retrieve(np.unique(term[inside])):
                if item not in found and index.shares_run(item, texts[k][a : a + PASSAGE]):
                    found.add(item)
        for item in found:
            yield ids[k], index.ids[item]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size; only one block is held at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.select(F.col(item_id).alias("i"), compact(F.col(text)).alias("t")).filter("t is not null").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_run: int = MIN_RUN,
) -> DataFrame:
    """Every (``doc_id``, ``item_id``) that share a run of ``min_run`` letters and digits.

    Null and empty texts leak nothing; repeated rows give a pair once; an empty table gives none;
    documents of any length are searched whole, in overlapping passages. Other columns are ignored.
    The corpus is only scanned, never shuffled. The items are a stated query set: they are sent out
    in blocks of :data:`BLOCK_CHARS` characters, each block a scan of its own.
    """
    spark = documents.sparkSession
    base = documents.select(F.col(doc_id).cast("long").alias("doc_id"), compact(F.col(doc_text)).alias("text")).filter(
        F.length("text") >= min_run
    )
    out = None
    for ids, texts in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((tuple(ids), tuple(texts)))

        def search(batches, shared=shared):
            index = _index(*shared.value, min_run)
            for batch in batches:
                rows = list(_search(index, batch["doc_id"].tolist(), batch["text"].tolist()))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")

        part = base.mapInPandas(search, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()


def leak_report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many documents hold it and from how many sources; 0 for clean items."""
    sources = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    counted = (
        found.join(sources, "doc_id")
        .groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    )
    return (
        items.select("item_id").distinct().join(counted, "item_id", "left").na.fill(0, ["n_docs", "n_sources"])
    )
