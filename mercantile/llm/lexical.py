"""Ranked lexical search with hashed max-sketches.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight in the whole table and its count in a document of
known length give an impact, a whole number; a document's score for an item is the sum of the impacts of the item's terms.

1. One pass counts documents, terms, and the documents of each item term (in tasks first).
2. A second pass folds each document's impacts into a sketch of ``PLACES`` places, by the top bits of the term's hash, keeping the largest
   impact of a place. Looked up for all items at once (a product of the sketches with the items' counts of terms by place), a
   sketch gives upper bounds: a place holds at least the impact of any term in it.
3. In a task each item takes its documents in the order of falling bounds and scores them exactly, until the bound is below its ``k``-th
   score so far, which is carried on through the task. Equal bounds are still scored, as ties go by doc_id.
4. The tasks' lists of at most ``k`` documents an item are merged in two steps, so no item's lists meet in one task at once.

Items are taken in blocks of bounded numbers of terms, each a pass of its own; a block's terms and counts are what is broadcast and collected.
Terms that no item of the block has could only loosen the bounds, and are left out of the sketches.

Defined results: rows of an item_id are one item, with the terms of all its texts (rows without item_id likewise). Items without terms have
no rows; NULL texts have no terms. Rows of documents are ranked each by itself, also equal ones and those of one doc_id; of equal scores those without
doc_id come last. Texts are taken whole; an empty table on either side gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.llm.tables import scratch
from mercantile.llm.textkit import LETTERS_AND_DIGITS, Hashes, find_words, lowered, signed, slices

BEST, PLACES = 50, 256
BLOCK_TERMS = 200_000
SALTS = 64
_DOCS, _HITS, _AT_ONCE = 4_096, 1_000_000, 256
_SCALE = 1_000_000_000


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for first, _, data, at in slices(batch.column(1)):
            data = lowered(data)
            words = find_words(data, at, LETTERS_AND_DIGITS)
            own = ids.take(pa.array(words.text + first))
            hashes = (pa.array(signed(Hashes(data, key).spans(words.start, words.end))) for key in (0, 1))
            yield pa.RecordBatch.from_arrays([own, *hashes], ["item_id", "h1", "h2"])


@dataclass
class Block:
    """Some items and their terms. Terms are in the order of their first hash, so also in that of their places."""

    items: list
    h1: np.ndarray
    h2: np.ndarray
    of_item: list[np.ndarray]
    weights: np.ndarray | None = None
    documents: int = 0
    terms: int = 0

    @property
    def place(self) -> np.ndarray:
        return (self.h1 >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) of every block term in every text, by text and term; and all terms of each text."""
        data = lowered(data)
        words = find_words(data, at, LETTERS_AND_DIGITS)
        hashes = Hashes(data).spans(words.start, words.end)
        term = np.minimum(np.searchsorted(self.h1, hashes), len(self.h1) - 1)
        met = np.flatnonzero(self.h1[term] == hashes)
        term = term[met]
        same = self.h2[term] == Hashes(data, 1).spans(words.start[met], words.end[met])
        found, times = np.unique(words.text[met[same]] * len(self.h1) + term[same], return_counts=True)
        return found // len(self.h1), found % len(self.h1), times, words.counts


def _block(rows: list) -> Block:
    """From (item_id, h1, h2), without repeats."""
    hashes = np.array([(r["h1"], r["h2"]) for r in rows], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    terms, number = np.unique(hashes, axis=0, return_inverse=True)
    own: dict = {}
    for r, k in zip(rows, number.ravel().tolist(), strict=True):
        own.setdefault(r["item_id"], []).append(k)
    return Block(list(own), terms[:, 0].copy(), terms[:, 1].copy(), [np.array(sorted(k)) for k in own.values()])


def _counted(block):
    """A task's documents of each term, and as terms -1 and -2 its documents and its terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        docs, some, size = np.zeros(len(own.h1), np.int64), 0, 0
        for batch in batches:
            for _, _, data, at in slices(batch.column(1)):
                _, term, _, counts = own.hits(data, at)
                docs += np.bincount(term, minlength=len(docs))
                some += int((counts > 0).sum())
                size += int(counts.sum())
        met = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[met, -1, -2]), pa.array(np.r_[docs[met], some, size])], ["term", "n"])

    return run


class _Best:
    """The best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.known, self.scores = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below it do not matter any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        ids, known, scores = np.r_[self.ids, ids], np.r_[self.known, known], np.r_[self.scores, scores]
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.ids, self.known, self.scores = ids[order], known[order], scores[order]


class _Chunk:
    """Documents with the impacts of their terms."""

    def __init__(self, block: Block):
        self.block, self.place = block, block.place
        self.rows: list = []
        self.docs = self.hits = 0
        # How many terms an item has in each place.
        self.lookup = np.zeros((PLACES, len(block.items)))
        for k, terms in enumerate(block.of_item):
            self.lookup[:, k] = np.bincount(self.place[terms], minlength=PLACES)
        self.marked = np.zeros(len(block.h1), dtype=bool)

    def add(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        text, term, times, counts = self.block.hits(data, at)
        m = 50 + (50 * counts[text] * self.block.documents) // max(self.block.terms, 1)
        impact = self.block.weights[term] * ((_SCALE * times) // (1000 * times + 20 * m))
        some, first = np.unique(text, return_index=True)  # the others score 0
        self.rows.append((ids[some], known[some], np.diff(np.r_[first, len(text)]), term, impact))
        self.docs += len(some)
        self.hits += len(text)

    def sketches(self, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        cell = np.repeat(np.arange(len(sizes)) * PLACES, sizes) + self.place[term]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out = np.zeros(len(sizes) * PLACES)
        out[cell[first]] = np.maximum.reduceat(impact, first)
        return out.reshape(len(sizes), PLACES)

    def search(self, best: list[_Best]) -> None:
        """Rank the documents for each item, and forget them."""
        if not self.docs:
            return
        ids, known, sizes, term, impact = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        begin = np.cumsum(sizes) - sizes
        # A little above: sums of large numbers are rounded.
        bounds = (self.sketches(sizes, term, impact) @ self.lookup) * (1 + 1e-9) + 1
        for k, found in enumerate(best):
            near = np.flatnonzero(bounds[:, k] >= found.least)
            near = near[np.argsort(-bounds[near, k], kind="stable")]
            self.marked[self.block.of_item[k]] = True
            for a in range(0, len(near), _AT_ONCE):
                own = near[a : a + _AT_ONCE]
                own = own[bounds[own, k] >= found.least]
                if not len(own):
                    break
                ends = np.cumsum(sizes[own])
                spot = np.repeat(begin[own] - (ends - sizes[own]), sizes[own]) + np.arange(ends[-1])
                exact = np.add.reduceat(np.where(self.marked[term[spot]], impact[spot], 0), ends - sizes[own])
                found.add(ids[own], known[own], exact)
            self.marked[self.block.of_item[k]] = False
        self.rows, self.docs, self.hits = [], 0, 0


def _searched(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        chunk, best = _Chunk(own), [_Best(k) for _ in own.items]
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for first, end, data, at in slices(batch.column(1)):
                chunk.add(ids[first:end], known[first:end], data, at)
                if chunk.docs >= _DOCS or chunk.hits >= _HITS:
                    chunk.search(best)
        chunk.search(best)
        for item, found in zip(own.items, best, strict=True):
            n = len(found.ids)
            if n:
                columns = [pa.array([item] * n, pa.int64()), pa.array(found.ids, pa.int64(), mask=~found.known), pa.array(found.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def _weighed(block: Block, counts: list) -> Block:
    """The block with the table's figures: weights of terms, documents with a term, and terms of all documents."""
    n = {r["term"]: r["n"] for r in counts}
    documents = n.get(-1, 0)
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(block.h1))]
    return Block(block.items, block.h1, block.h2, block.of_item, np.array(weights, dtype=np.int64), documents, n.get(-2, 0))


def _first(rows: DataFrame, k: int, *groups: Column) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    store = scratch(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = store.store(asked.mapInArrow(_item_terms, "item_id long, h1 long, h2 long").distinct(), "items")
    blocks = max(1, -(-terms.count() // block_terms))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for nth in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == nth).collect()
        if not rows:
            continue
        block = _block(rows)
        counts = chosen.mapInArrow(_counted(spark.sparkContext.broadcast(block)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        block = _weighed(block, counts.collect())
        lists = chosen.mapInArrow(_searched(spark.sparkContext.broadcast(block), k), "item_id long, doc_id long, score long")
        lists = lists.select("*", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
        found = found.unionByName(_first(lists, k, F.col("item_id"), F.col("salt")).select("item_id", "doc_id", "score"))
    return _first(found, k, F.col("item_id")).select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
facts AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM texts),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
held AS (SELECT own, doc_id, term, count(*) AS tf, n FROM (SELECT own, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts) GROUP BY own, doc_id, term, n),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, facts GROUP BY term, n_docs),
scored AS (
  SELECT a.item_id, h.own, h.doc_id, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * h.n * f.n_docs) // f.n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN held h ON h.term = a.term JOIN weighed w ON w.term = a.term, facts f GROUP BY a.item_id, h.own, h.doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored WHERE score > 0) WHERE place <= 50
"""
