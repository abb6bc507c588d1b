"""Encoding, lexical search and spelling variants against plain versions, on awkward documents and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from mercantile.llm import bpe, edits, lexical, parts, queries, sketch, spelling
from mercantile.sources.scratch import Scratch
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def awkward_texts():
    rng = random.Random(8)
    letters = "ab \n\t é日🙂'sl1.<|>　 \u0085 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c1", "<|endoftext<|endoftext|>", "it's we'll 'sx --'s 'tis", "x" * 3000, "日本語" * 500]
    return texts


def test_encoding_equals_the_library(library):
    own, texts = bpe.codec(PATH), awkward_texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        for first, end, ids, ends in own.ids.texts(pa.array(texts)):
            for k in range(first, end):
                assert ids[ends[k - first] : ends[k - first + 1]].tolist() == expected[k], texts[k]


def test_long_words_alone_and_together(library, monkeypatch):
    own, words = bpe.codec(PATH), [t.replace(" ", "").encode() for t in ("inter" * 40, "o" * 300, "thequickbrownfox" * 20)]
    expected = [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    for alone in (1, 1000):
        monkeypatch.setattr(bpe, "_ALONE", alone)
        ids, sizes = own.pairs.encode(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_a_small_vocabulary():
    vocabulary = {t: k for k, t in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa", b"aaaa"])}
    merges = [(b"b", b"c"), (b"a", b"b"), (b"ab", b"c"), (b"a", b"a"), (b"aa", b"aa")]
    own = bpe.PairEncoder(vocabulary, merges)

    def merged(word):
        parts_ = [word[k : k + 1] for k in range(len(word))]
        for a, b in merges:
            k = 0
            while k + 1 < len(parts_):
                if (parts_[k], parts_[k + 1]) == (a, b):
                    parts_[k : k + 2] = [a + b]
                k += 1
        return [vocabulary[p] for p in parts_]

    rng = random.Random(1)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    ids, sizes = own.encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [merged(w) for w in words]


def test_parts_tile_texts_and_stay_within_them():
    texts = awkward_texts()
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found, bounds = parts.cut(data, at, parts.pattern_of(["<|endoftext|>"]))
    found = [x.as_py() for x in found]
    assert [b"".join(found[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == texts
    assert max(map(len, found)) < 4600 and len(found) > 3 * len(texts)


def test_bpe(docs, plain, empty, library):
    both = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()
    expected = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in plain), key=str)
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in both), key=str)
    assert got == expected and all(len(r["ids"]) == 4 * r["n_tokens"] for r in both)
    assert bpe.decode_ids(bpe.encode_texts(empty, PATH), PATH).count() == 0


def test_any_ids_decode_as_in_the_library(spark, library):
    rng = random.Random(4)
    rows = [(k, 0, [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randint(0, 12))]) for k in range(300)]
    table = spark.createDataFrame([(k, n, np.array(ids, "<u4").tobytes()) for k, n, ids in rows] + [(None, 0, None)], "doc_id long, n_tokens long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(table, PATH).collect()}
    assert got == {k: library.decode(ids, skip_special_tokens=False) for k, _, ids in rows} | {None: ""}


def test_bpe_digests(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def ranked(rows, items, k=50):
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(TERMS(text))
    held = [(i, Counter(TERMS(t))) for i, t in rows]
    n_docs, size = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, own in terms.items():
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // max(size, 1)
            scores.append((sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t]), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def TERMS(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text))


def test_lexical_search(spark, docs, plain, empty, monkeypatch):
    prose = next(t for i, t in plain if i == 20)
    items = [(1, " ".join(prose.split()[:25])), (2, prose.upper()), (3, "One"), (4, None), (5, "!!"), (1, "ONE x"), (None, "a b"), (10, "nowhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["item_id", "rank", "doc_id", "score"]

    def got(*more, **named):
        return sorted(map(tuple, lexical.search(docs, bench, *more, **named).select(*columns).collect()), key=str)

    assert got() == ranked(plain, items) and len(got()) > 100
    monkeypatch.setattr(lexical, "_DOCS", 7)
    monkeypatch.setattr(lexical, "_AT_ONCE", 2)
    assert got(3) == ranked(plain, items, 3)
    assert got(3, block_terms=20) == ranked(plain, items, 3)
    assert lexical.search(empty, bench).count() == 0 and lexical.search(docs, bench.limit(0)).count() == 0


def test_sketches_bound_scores_and_save_work(spark):
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in range(900)]
    texts = [" ".join(words[x] for x in (rng.zipf(1.3, 60) - 1) % 900) for _ in range(800)]
    rows = []
    for item in range(4):
        column = pa.array([" ".join(words[x] for x in rng.integers(0, 900, 30))])
        _, _, data, at = next(lexical.slices(column))
        found = lexical.find_words(data, at, lexical.LETTERS_AND_DIGITS)
        pair = [lexical.signed(lexical.Hashes(data, k).spans(found.start, found.end)).tolist() for k in (0, 1)]
        rows += [{"item_id": item, "h1": a, "h2": b} for a, b in set(zip(*pair, strict=True))]
    block = lexical._block(rows)
    block.weights, block.documents, block.terms = rng.integers(1, 9000, len(block.h1)), 800, 48_000
    chunk = lexical._Chunk(block)
    for _, _, data, at in lexical.slices(pa.array(texts)):
        chunk.add(np.arange(800), np.ones(800, bool), data, at)
    ids, _, sizes, term, impact = (np.concatenate(x) for x in zip(*chunk.rows, strict=True))
    bounds = chunk.sketches(sizes, term, impact) @ chunk.lookup
    for k, own in enumerate(block.of_item):
        exact = np.add.reduceat(np.where(np.isin(term, own), impact, 0), np.cumsum(sizes) - sizes)
        assert (bounds[:, k] >= exact).all()
        # Documents that have to be scored for the best ten: far from all.
        assert (bounds[:, k] >= np.sort(exact)[-10]).sum() < len(ids) / 2


def variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    close = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), None if form[w] is None else words[form[w]]))
    return sorted(out, key=str)


def misspelt_documents(spark):
    """Words in long chains of ever rarer variants, next to the awkward documents."""
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in brute.documents(spark).collect()]
    for k in range(300):
        words = []
        for _ in range(60):
            word = list(rng.choice(["chestnut", "mountain", "abcdeé", "ÀÉÎÕÜàéîõü", "letter", "letters", "better"]))
            for _ in range(min(rng.getrandbits(3).bit_count(), 3)):
                place = rng.randrange(len(word))
                word[place : place + rng.randint(0, 1)] = rng.choice(["", "x", "a", "é", "ÿ", "×"])
            words.append("".join(word).title() if rng.random() < 0.1 else "".join(word))
        rows.append((1000 + k, rng.choice([" ", "-", "\n", "1"]).join(words)))
    return rows


def test_spelling_variants(spark, empty):
    rows = misspelt_documents(spark) + [(5000 + k, "a" * 700 + "b" * (k % 2)) for k in range(7)]
    expected = variants(rows)
    assert len(expected) > 800 and sum(r[1] is not None for r in expected) > 300
    assert any(r[2] not in (r[0], r[1]) for r in expected)  # chains
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.group_variants(table)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert spelling.group_variants(empty).count() == 0


def test_spelling_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op13_spelling_variants(spark, folder).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect()), key=str) == variants(rows)


def test_no_table_of_spelling_variants_is_broadcast(spark, monkeypatch):
    # Broadcast tables are collected on the driver, and these grow with the vocabulary.
    plans, plain = [], Scratch.store

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "store", noted)
    table = spark.createDataFrame(misspelt_documents(spark), "doc_id long, text string")
    plans.append(spelling.group_variants(table)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_bitmap_of_spelling_variants_is_bounded(spark, monkeypatch):
    asked, plain = [], sketch.members
    monkeypatch.setattr(sketch, "members", lambda keys, column, bits, lines=2: asked.append(bits) or plain(keys, column, bits, lines))
    monkeypatch.setattr(spelling, "KNOWN_BITS", sketch.LEAST_BITS - 6)  # a bitmap that nearly every variant passes
    rows = misspelt_documents(spark)
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == variants(rows) and asked == [10]


def test_one_edit_apart():
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) for _ in range(2)) for _ in range(2000)]

    def near(a, b):
        return a != b and (b in {a[:k] + a[k + 1 :] for k in range(len(a))} or a in {b[:k] + b[k + 1 :] for k in range(len(b))} or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)

    left, right = (pa.array(side) for side in zip(*pairs, strict=True))
    assert edits.one_edit_apart(left, right).tolist() == [near(a, b) for a, b in pairs]
    long = "ab" * 500_000
    assert edits.one_edit_apart(pa.array([long, long, long]), pa.array([long + "c", long[:77] + "x" + long[78:], "c" + long + "c"])).tolist() == [True, True, False]


def test_checksums():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 100))).encode() for _ in range(300)] + [b"x" * 5000]
    at = np.r_[0, np.cumsum([len(w) for w in words])]
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(words))], dtype=np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:], before)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(words)]
