"""Evaluation texts leaking into training texts (problem 7).

Wu-Manber multi-pattern search over words. Patterns are all runs of ``words`` words of the items. A block is two words.
The shift table says for each block how far the window may move at once; a block no pattern holds moves it by
``words - 1``. Where the shift is 0, the bucket of the suffix block, split by the pattern's first block, gives the few
patterns that are compared word by word. Documents are read once, whole, and never shuffled; only pairs leave the scan.

The items are the stated query set. Their different runs are made distributed and taken in blocks of about ``block_patterns``
runs by hash, each block broadcast, with one pass over the documents for each, one after the other: items of any number and
length work, and the driver holds one block at a time.

Defined results: words are maximal runs of letters and digits (Unicode), compared in lower case. Items or documents that
are null or shorter than ``words`` have no case. Repeated documents each give their own rows under their own ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.runtime import cut

_WORD = re.compile(r"[^\W_]+")
BLOCK_PATTERNS = 500_000


def words_of(text: str) -> list[str]:
    if "İ" in text or "Σ" in text:  # lower case of these depends on, or makes, neighbours
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def runs_of(text: str, words: int) -> set[tuple[str, ...]]:
    w = words_of(text or "")
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


class Patterns:
    """Shift table and buckets of a set of (item, run of words)."""

    def __init__(self, runs: Iterable[tuple[int, tuple[str, ...]]], words: int):
        self.words = words
        self.far = words - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, str], list[tuple[list[str], int]]]] = {}
        for item, run in runs:
            for q in range(1, words):
                block = (run[q - 1], run[q])
                self.shift[block] = min(self.shift.get(block, self.far), words - 1 - q)
            self.buckets.setdefault((run[-2], run[-1]), {}).setdefault((run[0], run[1]), []).append((list(run), item))

    @classmethod
    def of_texts(cls, items: Iterable[tuple[int, str]], words: int) -> Patterns:
        return cls(((item, run) for item, text in items for run in sorted(runs_of(text, words))), words)

    def search(self, text: str) -> dict[int, list[int]]:
        """item -> [number of places, first word] of the runs the text holds."""
        w, found = words_of(text), {}
        shift, far, buckets, back = self.shift.get, self.far, self.buckets, self.words - 1
        i, n = back, len(w)
        while i < n:
            block = (w[i - 1], w[i])
            if step := shift(block, far):
                i += step
                continue
            start = i - back
            for run, item in buckets[block].get((w[start], w[start + 1]), ()):
                if w[start : i + 1] == run:
                    found.setdefault(item, [0, start])[0] += 1
            i += 1
        return found


def _scan(documents: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    out += [(doc, item, n, first) for item, (n, first) in patterns.search(text).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "n_runs", "first_word"])

    return documents.mapInArrow(run, "doc_id bigint, item_id bigint, n_runs bigint, first_word bigint")


def item_runs(items: DataFrame, words: int) -> DataFrame:
    """item_id, run (words joined by spaces): the different runs of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if runs := [" ".join(r) for r in runs_of(text, words)]:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(runs), pa.int64()), pa.array(runs, pa.string())], ["item_id", "run"])

    return items.mapInArrow(run, "item_id bigint, run string").distinct()


def leaks(documents: DataFrame, items: DataFrame, words: int = 12, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """doc_id, item_id, n_runs (places where a run of ``words`` words of the item stands), first_word (of the first)."""
    if words < 3:
        raise ValueError("a pattern needs three words or more")
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    queries = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    runs = cut(item_runs(queries, words))
    blocks = max(1, -(-runs.count() // block_patterns))
    parts = []
    for k in range(blocks):
        block = runs.where(F.pmod(F.xxhash64("run"), F.lit(blocks)) == k) if blocks > 1 else runs
        shared = spark.sparkContext.broadcast(Patterns(((r["item_id"], tuple(r["run"].split(" "))) for r in block.collect()), words))
        part = _scan(texts, shared)
        if blocks > 1:
            part = cut(part)
            shared.destroy()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_runs").alias("n_runs"), F.min("first_word").alias("first_word"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Documents per leaked item, with its suite."""
    per_item = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_runs").alias("n_runs"))
    return items.select("item_id", "suite").join(per_item, "item_id")
