"""Every operator against a plain version, on awkward documents and on empty tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from mercantile.llm import components, decontamination, language, line_dedup, mixing, near_dedup, nearest, quality, sketch, substring_dedup, token_counts, token_files
from mercantile.sources.scratch import Scratch
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_substring_dedup(docs, plain, empty):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert found(substring_dedup.dedup_windows(docs), *columns) == sorted(brute.windows_removed(plain), key=str)
    texts = substring_dedup.dedup_windows(docs, with_text=True).where("n_removed > 0").collect()
    assert texts and all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in texts)
    assert substring_dedup.dedup_windows(empty).count() == 0


def test_decontamination(spark, docs, plain, empty):
    prose = next(t for i, t in plain if i == 20)
    items = [(1, " ".join(prose.split()[:25])), (2, prose.upper()), (3, "One"), (4, None), (5, "!!"), (1, "ONE"), (None, "a b"), (10, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    result = decontamination.find_contamination(docs, bench).cache()
    assert found(result, *columns) == sorted(brute.contamination(plain, items), key=str)
    assert all(sum(b - a for a, b in r["spans"]) == r["n_hit"] for r in result.collect())
    kept = decontamination.without_contamination(docs, bench)
    assert kept.columns == docs.columns and kept.count() == result.where("NOT contaminated").count()
    assert decontamination.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_contamination(empty, bench).count() == 0


def test_line_dedup(docs, empty):
    docs = docs.where("doc_id IS NULL OR doc_id <> 3")  # rows of one doc_id have no order that a reader sees
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute.lines_removed(rows)
    assert sum(r[2] for r in expected) > 20
    assert found(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(expected, key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_duplicates(docs, plain, empty):
    assert found(near_dedup.near_duplicates(docs), "doc_id", "class_id") == sorted(brute.classes(plain), key=str)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in brute.classes(plain)} | {None}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_families_of_near_copies(spark):
    """Members that are unlike the centre and like each other: edits, cuts, additions and second centres."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(400)]

    def edited(text, share):
        return [words[rng.integers(400)] if rng.random() < share else w for w in text]

    rows = []
    for size in (60, 150):
        centre = [words[x] for x in rng.integers(0, 400, size)]
        rows += [edited(centre, share) for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(12)]
        rows += [centre[: int(size * part)] for part in np.linspace(0.4, 1, 15)] + [centre[int(size * part) :] for part in np.linspace(0, 0.6, 15)]
        second = edited(centre, 0.05)
        rows += [edited(second, share) for share in (0.0, 0.005, 0.01, 0.02) for _ in range(8)]
        rows += [centre + centre[:k] for k in (8, 20, 40)] + [centre[:-10] + ["again"] * k for k in (5, 12, 40, 45)]
    rows = [(i, " ".join(row)) for i, row in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute.classes(rows), key=str)
    assert 20 < len({c for _, c in expected}) < len(rows) - 50
    assert found(near_dedup.near_duplicates(table), "doc_id", "class_id") == expected


def test_signatures_are_unbiased():
    rng, n = np.random.default_rng(3), 400
    left = [[f"w{x}" for x in rng.integers(0, 30, 50)] for _ in range(n)]
    right = [[x if rng.random() > 0.1 else f"z{rng.integers(9)}" for x in words] for words in left]
    import pyarrow as pa

    columns = [pa.array([" ".join(w) for w in side]) for side in (left, right)]
    parts = []
    for column in columns:
        found_ = [near_dedup.signatures(*near_dedup.bags(data, at, 1)[:3], b - a) for a, b, data, at in near_dedup.slices(column)]
        parts.append(np.concatenate(found_))
    true = []
    for a, b in zip(left, right, strict=True):
        x, y = brute.Counter(a), brute.Counter(b)
        true.append(sum((x & y).values()) / sum((x | y).values()))
    error = (parts[0] == parts[1]).mean(axis=1) - np.array(true)
    assert abs(error.mean()) < 0.008 and error.std() < 0.06


def test_components(spark, tmp_path):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, str(tmp_path)))
    assert {r["node"]: r["root"] for r in got.collect()} == {k: 0 if k < 41 else 100 if k < 160 else 200 for k in [*range(41), *range(100, 160), 200, 201]}


def test_sketch_misses_nothing(spark):
    keys = spark.range(0, 20_000, 7)
    bits = sketch.members(keys, "id", 18)
    import pyarrow as pa

    member = sketch.is_member(bits, pa.array([*range(0, 20_000), None]))
    assert member[0:20_000:7].all() and not member[-1] and member.mean() < 0.25


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(61, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_scored(docs, quality.Trees(9.0)).columns == docs.columns


def test_quality_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() / got.count() > 0.95


def test_trees_walk_as_they_were_fitted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.97
    row, margin = x[17], model.prior
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        margin += leaf[node - len(feature)]
    assert model.score(x)[17] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_language(spark, docs, empty):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    got = language.identify(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] not in (None, 3):
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.identify(docs.where("lang IS NULL")).collect()} == {"und"}
    assert language.identify(empty).count() == 0


def test_bundles_are_bound_trigrams():
    own = language.TrigramVectors(64)
    space, a, b = (own.letter(ord(c)) for c in " ab")
    expected = np.roll(space, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * space
    assert (language.bundle(["AB!", "", "??"], 64) == np.stack([expected, expected * 0, expected * 0])).all()


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("é", -3.0)]
    every_byte = own + [(f"<0x{b:02X}>", -4.0) for b in range(256)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for pieces, by_byte in ((token_counts.model_pieces(path), True), (own, False), (every_byte, True)):
        real = Tokenizer(models.Unigram(pieces, 0, by_byte))
        real.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        found = token_counts.count_tokens(docs, pieces).collect()
        for r in found:
            if r["doc_id"] not in (None, 3):
                assert r["n_tokens"] == len(real.encode(texts[r["doc_id"]] or "").ids)
        counter = token_counts.Counter(pieces)
        for text in ("<unk>", "é<unk>", "<unk>日", "<unk><unk>", "a<unk>b", "日本a日", "<0x41>", "日" * 500, "🙂b🙂🙂"):
            assert counter.text(text)[0] == len(real.encode(text).ids), text
    # The score is that of the tokens, where none is unknown.
    pieces = dict(token_counts.model_pieces(path))
    real = Tokenizer(models.Unigram(list(pieces.items()), 0, True))
    real.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for text in ("the quick brown fox", "a b", "One."):
        assert token_counts.Counter(list(pieces.items())).text(text)[1] == pytest.approx(sum(pieces[t] for t in real.encode(text).tokens))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_files(docs, plain, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.read_documents(token_files.write_tokens(docs, path))
    expected = brute.token_rows(plain, Tokenizer.from_file(path))
    assert found(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)
    assert token_files.read_documents(token_files.write_tokens(empty, path)).count() == 0


@pytest.mark.parametrize("kind", ["small", "wide", "mixed", "none", "one"])
def test_segments_round_trip(kind):
    rng = np.random.default_rng(2)
    n = {"none": 0, "one": 1}.get(kind, 3000)
    ids = rng.integers(0, {"small": 3, "wide": 2**32}.get(kind, 50), n).astype(np.uint32)
    if kind == "mixed":
        ids[rng.integers(0, n, 200)] = 2**32 - 1
    counts = np.array([n // 3, 0, n - n // 3])
    segment = token_files.Segment(token_files.encode_segment(np.array([5, 0, 9]), np.array([True, False, True]), counts, ids))
    assert (segment.ids() == ids).all() and segment.doc_ids.tolist() == [5, 0, 9] and segment.has_id.tolist() == [True, False, True]
    assert (segment.document(2) == ids[n // 3 :]).all() and len(segment.document(1)) == 0


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(mixing.quality_weights(docs, labels)).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    sources = sorted({r["source"] for r in got}, key=lambda s: (s is None, s))
    for k, source in enumerate(sources):
        own = [r for r in got if r["source"] == source]
        size = sum(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {size} and all(r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert sum(next(r["target"] for r in got if r["source"] == s) for s in sources) == pytest.approx(total)
    assert mixing.mix(mixing.quality_weights(empty, labels)).count() == 0


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: (r["target"], r["epochs"]) for r in mixing.targets(sizes).collect()}
    assert got == {"a": (960.0, 0), "b": (30.0, 3), "c": (30.0, 3), None: (0.0, 0)}


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32).tolist()
    vectors[100:400] = [vectors[100]] * 300  # a hot vector
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    table = spark.createDataFrame(rows + [(2000 + 20 * k, v, "y") for k, v in enumerate(bad)] + [(None, vectors[0], "z"), rows[40]], "vec_id long, embedding array<float>, gid string")
    got = nearest.nearest(table).toPandas()
    x = np.array(vectors, dtype=np.float64)
    assert sorted(got["query_id"].unique()) == list(range(0, 1500, 20))
    hit = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        scores = x @ x[q]
        assert np.allclose(own["score"], scores[own["vec_id"]], rtol=0, atol=1e-12)
        assert own[["score", "vec_id"]].apply(lambda r: (-r.iloc[0], r.iloc[1]), axis=1).is_monotonic_increasing
        scores[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(1500), -np.round(scores, 9)))[:20]) & set(own["vec_id"]))
    assert hit / len(got) >= 0.9
    few = nearest.nearest(table.where("vec_id < 5")).collect()
    assert [r["vec_id"] for r in few] and {r["query_id"] for r in few} == {0} and len(few) == 4
    assert nearest.nearest(table.limit(0)).count() == 0
