"""Texts that defeat weak hashes or quadratic steps."""

import time

import numpy as np
import pytest

from mercantile.llm import decontamination, line_dedup, near_dedup, substring_dedup, textkit
from tests.llm import brute


def thue_morse(bits: int, zero: str = "a", one: str = "b") -> tuple[str, str]:
    """A string of 2**bits characters and its complement: equal sums modulo 2**64 at every odd base from 1024 characters on."""
    signs = [0]
    for _ in range(bits):
        signs += [1 - s for s in signs]
    return "".join(one if s else zero for s in signs), "".join(zero if s else one for s in signs)


LEFT, RIGHT = thue_morse(11)


def test_spans_are_told_apart():
    data = np.frombuffer((LEFT + RIGHT + LEFT + "x" + LEFT).encode(), dtype=np.uint8)
    n = len(LEFT)
    start = np.array([0, n, 2 * n, 3 * n + 1])
    for key in (0, 1):
        a, b, c, d = textkit.hash_spans(data, start, start + n, key)
        assert a == c == d and a != b
    # The hash of a text with a part left out, and with a byte put in or replaced.
    own, hashes = textkit.Hashes(np.frombuffer(b"xabcdx", np.uint8)), lambda t: textkit.hash_spans(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]
    one = lambda *x: [np.array([k]) for k in x]
    assert own.without(*one(1, 2, 4, 5))[0] == hashes(b"ad")
    begin, cut, rest, end = one(1, 3, 3, 5)
    assert own.edited(begin, cut, ord("z"), rest, end)[0] == hashes(b"abzcd")
    begin, cut, rest, end = one(1, 2, 3, 5)
    assert own.edited(begin, cut, ord("z"), rest, end)[0] == hashes(b"azcd")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_near_dedup(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table(spark, [LEFT, RIGHT, LEFT])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_substring_dedup(spark):
    rest = " ".join(f"w{k}" for k in range(12))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_windows(table(spark, [f"{LEFT} {rest}", f"{RIGHT} {rest}", f"{LEFT} {rest}"])).collect()}
    assert got == {0: 0, 1: 0, 2: 13}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, LEFT)], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.find_contamination(table(spark, [f"one {LEFT} two", f"one {RIGHT} two"]), items).collect()}
    assert got == {0: True, 1: False}


def test_line_dedup(spark):
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table(spark, [LEFT, RIGHT, f"{LEFT}\n{RIGHT}"]), exact=1).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("edit", ["middle", "none"])
def test_long_lines_in_linear_time(spark, edit):
    rng = np.random.default_rng(3)
    line = "".join("abcdefgh "[k] for k in rng.integers(0, 9, 1_000_000))
    other = line[:500_000] + "x" + line[500_001:] if edit == "middle" else line[:500_000] + "xy" + line[500_002:]
    begin = time.time()
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table(spark, [line, other]), exact=1).collect()}
    assert got == {0: 0, 1: int(edit == "middle")} and time.time() - begin < 120


def test_many_hits_in_one_document(spark):
    """100,000 places in one document, each a hit of its own."""
    item = " ".join(f"i{k}" for k in range(10))
    text = " ".join(f"{item} other{k % 7}" for k in range(100_000))
    items = spark.createDataFrame([(1, item), (2, item + " more")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "clean text")], "doc_id long, text string")
    begin = time.time()
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items).collect()}
    assert got[1]["n_hit"] == 1_000_000 and len(got[1]["spans"]) == 100_000 and got[1]["item_ids"] == ["1", "2"]
    assert not got[2]["contaminated"] and time.time() - begin < 120


def test_winnowing_misses_no_window(spark):
    """Few words, so that grams repeat and tie everywhere."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("abc"[k] for k in rng.integers(0, 3, n))
    rows = [(k, prose(int(rng.integers(0, 120)))) for k in range(60)]
    items = [(k, prose(int(rng.integers(1, 40)))) for k in range(12)] + [(100, "a"), (101, "b c")]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items[:-2], "item_id long, text string")
    for own, chosen in ((bench, items[:-2]), (spark.createDataFrame(items, "item_id long, text string"), items)):
        got = decontamination.find_contamination(docs, own).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute.contamination(rows, chosen), key=str)
