"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

A document is the multiset of its shingles of ``SHINGLE`` words (lower-cased A-Z; letters, digits and characters beyond ASCII make
words); fewer words are one shingle. Similarity of two multisets: sum of the smaller counts over sum of the larger.

1. BagMinHash signatures. Counts are discretised into unit levels. Level 0 to 1, 1 to 2, 2 to 4, 4 to 8 and so on are independent
   Poisson processes per shingle, seeded by the shingle; a point has a value, a level within its interval and one of ``COMPONENTS``
   places. It counts for a document if its level is below the shingle's count; in partly covered intervals the others
   are thinned out. A component keeps the smallest value, so two documents agree in a component
   with the probability of their similarity. Points of a process come in ascending order, and one is followed only
   while it can still lower a component.
2. Documents of equal words are one node. ``BANDS`` bands of ``ROWS`` components are the keys by which nodes meet.
   At similarity 0.8 a pair meets in no band with probability (1 - 0.8**4)**24, 3 in a million.
3. In each band's bucket the node with the most meetings over all bands is the pivot, and all others are verified
   against it: exact multisets, whole texts. Verified pairs make components.
4. Buckets whose nodes are in one component are settled, however large. In the others two nodes of different components may still be
   similar to each other. At most one of them is similar to the pivot P, so they share a difference from it. Let t be the least
   similarity, o(A) the size of what A and P share, and need = t / (1 + t) * (|A| + |B|), which A and B have to share at least.
   Either they share an added shingle (one that P does not have); then the first one that they share, in any one order of
   all, is among the first |A| - t |A| + 1 of A, and of B. Or what they share is within P, which takes
   need <= min(o(A), o(B)), and |B| < |P| if A is not similar to P; then they lack a shingle of P in common, and the
   first in order is among the first o(A) / t - |A| + 1 that A lacks, and likewise for B. So nodes meet by differences,
   first with the one of most differences. Where components are still apart they meet with each other, by the first
   differences in the order of how many nodes have them, rare ones first: what a family has in common comes last. A
   difference that only one component has joins nothing and counts as the rarest. If the first difference that a pair
   shares has ``left`` ones from it on in each of the two lists, they share at most the smaller ``left`` added
   shingles, which with min(o(A), o(B)) has to reach need; and lack at most the smaller ``left`` in common, which has
   to reach need + |P| - o(A) - o(B). Pairs that pass these bounds are verified if their signatures agree in ``AGREE``
   components: at similarity 0.8, 77 of 96 are expected, and fewer than 56 have a probability below one in a million. No
   link is lost to a pivot; nothing is capped.

Defined results: a text without words is near only to the same bytes; NULL and empty texts are near to nothing. The
class is the smallest doc_id of the component. Rows without doc_id take part, and have the class of their component (NULL
if it has no doc_id). Very long texts are compared whole; an empty table gives no rows; columns other than doc_id and text may have
any name and are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mercantile.llm import sketch
from mercantile.llm.components import star_forest
from mercantile.llm.tables import free_name, scratch
from mercantile.llm.textkit import LETTERS_AND_DIGITS, SLICE_BYTES, find_words, hash_runs, hash_spans, lowered, mix, run_starts, signed, slices, utf8

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
AGREE = 56
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle of every text, by text; and a hash of each text's words."""
    data = lowered(data)
    words = find_words(data, at, LETTERS_AND_DIGITS)
    hashes = hash_spans(data, words.start, words.end)
    starts = run_starts(words, shingle)
    text, found = [words.text[starts]], [hash_runs(hashes, shingle, 11)[starts]]
    counts = words.counts
    for few in range(1, shingle):
        own = np.flatnonzero(counts == few)
        if len(own):
            text.append(own)
            found.append(hash_runs(hashes, few, 11)[words.first[own]])
    text, found = np.concatenate(text), np.concatenate(found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    # The words in order: positions weigh in, so that only equal sequences are equal.
    place = np.arange(len(hashes)) - words.first[words.text]
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(mix(hashes, 21) + place.astype(np.uint64) * _STEP), out=total[1:])
    whole = mix(total[words.first[1:]] - total[words.first[:-1]], 22) ^ counts.astype(np.uint64)
    return text[first], found[first], np.diff(np.r_[first, len(text)]), np.where(counts > 0, whole, 0)


def signatures(text: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures of n texts, as values; infinite for texts without shingles."""
    best = np.full(n * components, np.inf)
    text_of, seed, lower, length, limit = [text], [mix(shingles, 31)], [np.zeros(len(text), np.int64)], [np.ones(len(text), np.int64)], [counts]
    level = 1
    while len(more := np.flatnonzero(counts > level)):
        text_of.append(text[more])
        seed.append(mix(shingles[more], 31 + level))
        lower.append(np.full(len(more), level))
        length.append(np.full(len(more), level))
        limit.append(counts[more])
        level *= 2
    text_of, seed, lower, length, limit = (np.concatenate(x) for x in (text_of, seed, lower, length, limit))
    value = np.zeros(len(seed))
    while len(seed):
        steps = int(np.clip(100_000 // len(seed), 1, 32))
        draws = mix(seed[:, None] + np.arange(1, steps + 1, dtype=np.uint64) * _STEP)
        gaps = -np.log((draws >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (length * components)[:, None]
        values = value[:, None] + np.cumsum(gaps, axis=1)
        where = mix(draws, 41)
        place = ((where >> np.uint64(40)) * np.uint64(components)) >> np.uint64(24)
        height = lower[:, None] + ((((where & np.uint64(0xFFFFFF)) * length[:, None].astype(np.uint64)) >> np.uint64(24))).astype(np.int64)
        counted = height < limit[:, None]
        slot = (text_of[:, None] * components + place.astype(np.int64))[counted]
        np.minimum.at(best, slot, values[counted])
        most = best.reshape(n, components).max(axis=1)
        value = values[:, -1]
        open_ = value < most[text_of]
        text_of, seed, lower, length, limit, value = (x[open_] for x in (text_of, seed, lower, length, limit, value))
        seed = seed + np.uint64(steps * int(_STEP) % 2**64)
    return best.reshape(n, components)


def _keys(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and a byte per component."""
    code = mix(best.view(np.uint64), 51)
    parts = code.reshape(len(best), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP, (len(best), BANDS)).copy()
    for row in range(ROWS):
        keys = mix(keys ^ parts[:, :, row], 52)
    return keys, (code >> np.uint64(56)).astype(np.uint8)


def _refs(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    known = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    return mix(hash_spans(data, at[:-1], at[1:]) ^ mix(known.view(np.uint64), 77))


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in slices(batch.column(1)):
            ids = batch.column(0).slice(first, end - first)
            text, shingles, counts, node = bags(data, at)
            refs = _refs(ids, data, at)
            own = np.where(np.diff(at) > 0, mix(hash_spans(data, at[:-1], at[1:]), 61), mix(refs, 62))
            best = signatures(text, shingles, counts, end - first)
            some = np.zeros(end - first, dtype=bool)
            some[text] = True
            keys, marks = _keys(best[some])
            bounds = np.r_[0, np.cumsum(np.where(some, BANDS, 0))]
            bytes_at = np.zeros(end - first, dtype=object)
            bytes_at[some] = [m.tobytes() for m in marks]
            bytes_at[~some] = b""
            columns = [
                ids.cast(pa.int64()),
                pa.array(signed(refs)),
                pa.array(signed(np.where(some, node, own))),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(keys.ravel()))),
                pa.array(bytes_at.tolist(), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ref", "node", "bands", "marks"])


def _counts(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count on the left, count on the right) of every distinct shingle of each row's two texts."""
    sides = []
    for column in (left, right):
        parts = []
        for first, _, data, at in slices(column):
            text, shingles, counts, _ = bags(data, at)
            parts.append((text + first, shingles, counts))
        sides.append([np.concatenate(x) for x in zip(*parts, strict=True)])
    (t1, s1, c1), (t2, s2, c2) = sides
    row, shingle = np.r_[t1, t2], np.r_[s1, s2]
    one, two = np.r_[c1, np.zeros_like(c2)], np.r_[np.zeros_like(c1), c2]
    order = np.lexsort((shingle, row))
    row, shingle, one, two = row[order], shingle[order], one[order], two[order]
    first = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])][: len(row)])
    if not len(first):
        return row, shingle, one, two
    return row[first], shingle[first], np.add.reduceat(one, first), np.add.reduceat(two, first)


def _parts(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch (., ., text, text) whose texts have about ``most`` bytes."""
    at = np.r_[0, np.cumsum(sum(np.diff(utf8(c)[1]) for c in batch.columns[2:4]))]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row."""
    row, _, one, two = _counts(left, right)
    shared, total = (np.bincount(row, x, len(left)) for x in (np.minimum(one, two), one + two))
    return shared / np.maximum(total - shared, 1)


def _units(row, shingle, held, counts, n: int, pivot, salt: int) -> pa.ListArray:
    """Keys of the units of each of n rows: copy ``held`` and further ones, ``counts`` in all, of a shingle. Rows are in order."""
    at = np.repeat(np.arange(len(row)), counts)
    copy = held[at] + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    unit, row = mix(shingle[at] + copy.astype(np.uint64) * _STEP, 71), row[at]
    keys = mix(unit ^ mix(pivot.view(np.uint64), 72)[row], salt)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))], pa.int32()), pa.array(signed(keys)))


def _differences(least: float):
    """Rows (pivot, node, text, text) to the node's sizes, its differences, and among how many first ones it may meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                row, shingle, one, two = _counts(part.column(2), part.column(3))
                both = np.minimum(one, two)
                whole, size, own = (np.bincount(row, x, part.num_rows).astype(np.int64) for x in (one, two, both))
                linked = own >= (least - 1e-12) * (whole + size - own)
                added = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
                lacked = own / least - size
                lacked = np.where(linked, lacked, np.minimum(lacked, (whole - least * size) / (1 + least)))
                lacked = np.where((own >= least * size - 1e-9) & (~linked | (size < whole)), np.floor(lacked + 1e-9) + 1, 0).astype(np.int64)
                pivot = part.column(0).to_numpy()
                columns = [
                    *part.columns[:2],
                    *(pa.array(x) for x in (linked, whole, size, own, added, lacked)),
                    _units(row, shingle, both, two - both, part.num_rows, pivot, 73),
                    _units(row, shingle, both, np.where(lacked[row] > 0, one - both, 0), part.num_rows, pivot, 74),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["pivot", "node", "linked", "whole", "size", "own", "most_added", "most_lacked", "added", "lacked"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                # Shares of whole numbers: 4 of 5 is 0.8, without an error of rounding.
                near = similarity(part.column(2), part.column(3)) >= least - 1e-12
                yield part.select(["a", "b"]).filter(pa.array(near))

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            marks = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COMPONENTS) for c in batch.columns[2:]]
            yield batch.select(["a", "b"]).filter(pa.array((marks[0] == marks[1]).sum(axis=1) >= AGREE))


def _wanted(found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                refs = _refs(batch.column(0).slice(first, end - first), data, at)
                kept = pa.array(found.value.test(mix(refs)))
                texts = batch.column(1).slice(first, end - first).filter(kept)
                if len(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(refs)).filter(kept), texts], ["ref", "text"])

    return run


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``."""
    return _classes(docs, least).select("doc_id", "class_id")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, ref, class_id, first_ref) of every row: its own ref, and that of the first row of its class."""
    spark = docs.sparkSession
    store = scratch(spark)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = chosen.mapInArrow(_signed_rows, "doc_id long, ref long, node long, bands array<long>, marks binary")
    rows = store.store(rows, "signatures")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ref")).alias("lead")
    nodes = rows.groupBy("node").agg(lead, F.first("marks").alias("marks"), F.first("bands").alias("bands"))
    nodes = store.store(nodes.select("node", "lead.doc_id", "lead.ref", "marks", "bands"), "nodes")

    met = nodes.select("node", F.explode("bands").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "shared")
    met = store.store(met.join(sizes, F.col("key") == F.col("shared")).select("key", "node", "n"), "buckets")
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree")).withColumnRenamed("node", "of")
    ranked = met.join(degrees, F.col("node") == F.col("of")).select("key", "node", "degree")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("pivot")).select(F.col("key").alias("shared"), F.col("pivot.node").alias("pivot"))
    met = store.store(met.join(pivots, F.col("key") == F.col("shared")).select("key", "node", "pivot"), "spokes")
    low, high = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    stars = store.store(met.where("node <> pivot").select(low, high).distinct(), "stars")

    # All pairs below are of nodes of the stars. Only texts of these are shuffled.
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    wanted = store.store(nodes.select("node", "ref").join(wanted, "node"), "wanted")
    found = sketch.members(wanted, "ref", sketch.bits_for(4 * wanted.count()))
    texts = chosen.mapInArrow(_wanted(spark.sparkContext.broadcast(found)), "ref long, text string")
    texts = store.store(texts.join(wanted, "ref").dropDuplicates(["ref"]).select("node", "text"), "texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes with their texts."""
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def verified(pairs: DataFrame) -> DataFrame:
        return store.store(with_texts(pairs).mapInArrow(_similar(least), "a long, b long"), "links")

    def rooted(forest: DataFrame) -> DataFrame:
        """(of, root) of every node that is not the root of its component."""
        return forest.select(F.col("b").alias("of"), F.col("a").alias("root"))

    def unsettled(groups: DataFrame, roots: DataFrame) -> DataFrame:
        """The groups, by key, whose nodes are in different components; each row with its node's root and the group's size n."""
        placed = groups.join(roots, F.col("node") == F.col("of"), "left").select(groups["*"], F.coalesce("root", "node").alias("root"))
        held = placed.groupBy("key").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("n"))
        open_ = held.where("open").select(F.col("key").alias("shared"), "n")
        return placed.join(open_, F.col("key") == F.col("shared")).drop("shared")

    forest = star_forest(verified(stars), store)
    roots = rooted(forest)
    far = unsettled(met, roots).where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    far = store.store(far.distinct(), "far")
    if not far.isEmpty():
        columns = (
            "pivot long, node long, linked boolean, whole long, size long, own long, most_added long, most_lacked long, "
            "added array<long>, lacked array<long>"
        )
        apart = store.store(with_texts(far).mapInArrow(_differences(least), columns), "differences")
        facts = ["pivot", "node", "linked", "whole", "size", "own"]
        index = apart.select(F.explode("added").alias("key"), F.lit(True).alias("adds"), F.col("most_added").alias("most"), *facts)
        index = index.unionByName(apart.select(F.explode("lacked").alias("key"), F.lit(False).alias("adds"), F.col("most_lacked").alias("most"), *facts))
        need = f"({least / (1 + least)!r} * (size + size_2) - 1e-6)"
        fits = (
            f"root <> root_2 AND CASE WHEN adds THEN least(own, own_2) + least(size - own, size_2 - own_2) >= {need} "
            f"ELSE least(own, own_2) >= {need} AND (linked OR size_2 < whole) AND (linked_2 OR size < whole) END"
        )
        # Where the key is the first difference that both have.
        fits_first = (
            f"{fits} AND least(left, left_2) >= CASE WHEN adds THEN {need} - least(own, own_2) ELSE {need} + whole - own - own_2 END"
        )
        low, high = F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")
        marks, done = nodes.select("node", "marks"), stars

        def agreed(both: DataFrame, bounds: str) -> DataFrame:
            """New pairs (a, b) within the bounds whose signatures agree."""
            pairs = both.where(bounds).select(low, high).distinct().join(done, ["a", "b"], "left_anti")
            pairs = pairs.join(marks.toDF("a", "marks_a"), "a").join(marks.toDF("b", "marks_b"), "b").select("a", "b", "marks_a", "marks_b")
            return store.store(pairs.mapInArrow(_agreeing, "a long, b long"), "rest")

        def renamed(rows: DataFrame, *more: str) -> DataFrame:
            return rows.select("key", *(F.col(c).alias(c + "_2") for c in ("node", "root", "linked", "size", "own", *more)))

        index = store.store(unsettled(index, roots), "index")
        most = index.groupBy("node").agg(F.count("*").alias("degree"))
        ranked = index.join(most, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "root", "linked", "size", "own")).alias("lead"))
        pairs = agreed(index.join(renamed(ranked.select("key", "lead.*")), "key").where("node <> node_2"), fits)
        if not pairs.isEmpty():
            forest, done = star_forest(forest.unionByName(verified(pairs)), store), done.unionByName(pairs)
            roots = rooted(forest)
            index = store.store(unsettled(index.drop("root", "n"), roots), "index")
        last_first = Window.partitionBy("pivot", "node", "adds").orderBy(F.desc("n"), F.desc("key"))
        index = index.withColumn("left", F.row_number().over(last_first))
        index = store.store(index.where("left > CASE WHEN adds THEN size ELSE whole END - own - most"), "first")
        pairs = agreed(index.join(renamed(index, "left"), "key").where("node < node_2"), fits_first)
        if not pairs.isEmpty():
            roots = rooted(star_forest(forest.unionByName(verified(pairs)), store))

    placed = nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", "doc_id", "ref", F.coalesce("root", "node").alias("root"))
    placed = store.store(placed, "placed")
    classes = placed.groupBy("root").agg(lead).select("root", F.col("lead.doc_id").alias("class_id"), F.col("lead.ref").alias("first_ref"))
    of_node = placed.select(F.col("node").alias("of"), "root").join(classes, "root").select("of", "class_id", "first_ref")
    return rows.select("doc_id", "ref", "node").join(of_node, F.col("node") == F.col("of")).select("doc_id", "ref", "class_id", "first_ref")


def _with_refs(docs: DataFrame, name: str) -> DataFrame:
    """All columns and the row's ref, as ``_signed_rows`` makes it."""
    ids, texts = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, parts = batch.column(ids), [np.zeros(0, np.uint64)]
            for first, end, data, at in slices(batch.column(texts).cast(pa.string())):
                parts.append(_refs(column.slice(first, end - first), data, at))
            yield batch.append_column(name, pa.array(signed(np.concatenate(parts))))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each class its first row, all columns: that of the smallest doc_id (NULL last), then by a hash of the text. Of rows
    equal in doc_id and text one stays, unless the text is empty: those are near to nothing and all stay."""
    classes = scratch(docs.sparkSession).store(_classes(docs, least).select("ref", "first_ref"), "classes")
    own, left, more = (free_name(docs.columns, name) for name in ("row_ref", "gone_ref", "again_ref"))
    gone = classes.where("ref <> first_ref").select(F.col("ref").alias(left)).distinct()
    again = classes.where("ref = first_ref").groupBy(F.col("ref").alias(more)).count().where("count > 1").select(more)
    kept = _with_refs(docs, own)
    kept = kept.join(gone, F.col(own) == F.col(left), "left_anti")
    if not again.isEmpty():
        met = (F.col(own) == F.col(more)) & (F.octet_length(F.coalesce(kept["text"].cast("string"), F.lit(""))) > 0)
        kept = kept.join(again, met, "left_anti").unionByName(kept.join(again, met, "left_semi").dropDuplicates([own]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
