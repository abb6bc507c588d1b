"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The last token of a prefix's encoding is unique, and tokens follow each other in an encoding exactly if each two neighbours
do so on their own. So for every prefix of a word it is enough to store its last token:

1. A suffix automaton of the vocabulary reads the word; after each character its state and suffix links list the tokens that the
   prefix ends with, longest first.
2. Of these the last token is the one that is compatible with the last token of the prefix before it. Two tokens are compatible
   if merging never joins characters across their border: the merges that made them are undone, latest first, and
   no pair that stands at the border in between may have a merge of an earlier rank.
3. The back-pointers from the whole word give its ids.

Words are what the tokenizer's own pre-tokenizer makes of a text, with strings of added tokens taken out before. A text is
cut into parts first (see ``parts``), so a word that recurs is encoded once in a while only. Time is linear in the text, also for
a word of many megabytes.

Defined results: NULL and empty texts have no ids, and decode to an empty text. Every row is encoded by itself, so repeated
rows and rows without doc_id are kept as they are, very long texts are taken whole, an empty table gives no rows, and
other columns of the table are not looked at. Ids that are not in the vocabulary decode to nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm.parts import PartIds

_NEVER = 1 << 62
#: Bytes of the words that are encoded together.
_TABLE = 1 << 20
#: Longer words are encoded one by one.
_ALONE = 1 << 9
#: A blank and letters, all ASCII or of the two Latin blocks behind it: always one word, whatever the version of Unicode.
_ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+").fullmatch


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: the byte's own if it is printable in Latin-1,
    else the next unused one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of a set of byte strings. State 0 is the empty one; a string of the set has a state of its length."""

    def __init__(self, words: Sequence[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.of: dict[bytes, int] = {b"": 0}
        # By length, so that a word's prefix has its state before the word.
        prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
        for prefix in sorted(prefixes, key=len):
            self.of[prefix] = self._extended(self.of[prefix[:-1]], prefix[-1])
        self.of = {w: self.of[w] for w in words}

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _target(self, state: int, byte: int) -> int:
        """The state for ``state``'s longest string and the byte; it is split off if its state has longer ones."""
        old = self.next[state][byte]
        if self.length[old] == self.length[state] + 1:
            return old
        split = self._state(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = split
        while state >= 0 and self.next[state].get(byte) == old:
            self.next[state][byte] = split
            state = self.link[state]
        return split

    def _extended(self, state: int, byte: int) -> int:
        if byte in self.next[state]:
            return self._target(state, byte)
        new = self._state(self.length[state] + 1, 0, {})
        while state >= 0 and byte not in self.next[state]:
            self.next[state][byte] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._target(state, byte)
        return new


class Lookup:
    """Values of fixed whole-number keys, for many keys at once; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = int(max(len(keys), 1)).bit_length() + 1
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            rest = np.ones(len(keys), dtype=bool)
            rest[own] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class PairEncoder:
    """Encodes words of one vocabulary. ``merges`` are pairs of tokens in the order of their rank."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]]):
        n = max(vocabulary.values()) + 1
        self.n, self.size = n, np.zeros(n, np.int64)
        self.made, self.first, self.second = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3)
        rank = np.arange(len(pairs))
        self.made[pairs[:, 2]], self.first[pairs[:, 2]], self.second[pairs[:, 2]] = rank, pairs[:, 0], pairs[:, 1]
        if (np.maximum(self.made[pairs[:, 0]], self.made[pairs[:, 1]]) >= rank).any() or len(np.unique(pairs[:, 2])) < len(pairs):
            raise ValueError("a merge comes before its parts, or makes a token again")
        self.rank = Lookup(pairs[:, 0] * n + pairs[:, 1], rank)

        ids = np.array(sorted(vocabulary.values()))
        merged = ids[self.made[ids] >= 0]
        reached = np.zeros(n, dtype=bool)
        reached[merged] = self._stand(self.first[merged], self.second[merged], self.made[merged])
        for i in merged[np.argsort(self.made[merged])].tolist():  # and so are its halves
            reached[i] &= all(reached[h] or self.made[h] < 0 for h in (self.first[i], self.second[i]))
        reached[ids[(self.made[ids] < 0) & (self.size[ids] == 1)]] = True
        tokens = {t: i for t, i in vocabulary.items() if reached[i]}

        machine = SuffixAutomaton(list(tokens))
        self.link, self.length = np.array(machine.link), np.array(machine.length)
        self.token = np.full(len(self.link), -1, np.int64)
        for t, i in tokens.items():
            self.token[machine.of[t]] = i
        # The nearest state up the suffix links that is a token; links lead to shorter strings.
        self.above = np.zeros(len(self.link), dtype=np.int64)
        for state in np.argsort(self.length, kind="stable")[1:].tolist():
            up = machine.link[state]
            self.above[state] = up if self.token[up] >= 0 else self.above[up]
        edges = [(state * 256 + byte, to) for state, following in enumerate(machine.next) for byte, to in following.items()]
        edges = np.array(edges, dtype=np.int64).reshape(-1, 2)
        self.edges = Lookup(edges[:, 0], edges[:, 1])
        self.plain: dict | None = None

    def _stand(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge before rank ``until`` joins bytes across the border of the tokens a and b, for many pairs."""
        out = np.ones(len(a), dtype=bool)
        own = np.arange(len(a))
        while len(own):
            rank = self.rank.get(a * self.n + b)
            crossed = (rank >= 0) & (rank < until)
            out[own[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            # What was made last is undone: before that its half stood at the border. Of equal pairs the left one is merged
            # first, so one across the border wins over b's own.
            left = made_a > made_b
            until = np.where(left, made_a, made_b + 1)
            on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            a, b = np.where(left, self.second[a], a), np.where(left, b, self.first[b])
            own, a, b, until = own[on], a[on], b[on], until[on]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' bytes is these two tokens, for many pairs."""
        return self._stand(a, b, np.full(len(a), _NEVER))

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, which the vocabulary's single bytes can spell, and each word's number of ids.

        The words go forward together, one byte at a time, longest first: those that have ended are the last ones.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = np.zeros(len(words), dtype=np.int64)
        kept, at = [], 0
        while at < len(order) and lengths[order[at]] > _ALONE:
            kept.append(self._encode_alone(words[order[at]]))
            sizes[order[at]] = len(kept[-1])
            at += 1
        while at < len(order):
            # Of like lengths and bounded size.
            most = max(int(lengths[order[at]]), 1)
            end = at + max(1, min(_TABLE // most, int(np.searchsorted(-lengths[order[at:]], -(most // 2), side="right"))))
            own = order[at:end]
            ids, sizes[own] = self._encode_table([words[k] for k in own.tolist()], lengths[own])
            kept.append(ids)
            at = end
        flat = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
        # Back from the order of lengths to that of the words.
        begins = np.zeros(len(words), dtype=np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _encode_table(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(lengths) - lengths
        # The last token of every prefix, by word and end.
        last = np.zeros(len(data), dtype=np.int32)
        state, matched = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for end in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -end, side="left"))
            state, matched = state[:n], matched[:n]
            spot = begin[:n] + end
            byte = data[spot].astype(np.int64)
            to = self.edges.get(state * 256 + byte).astype(np.int64)
            open_ = np.flatnonzero(to < 0)
            while len(open_):
                up = self.link[state[open_]]
                if (up < 0).any():
                    raise ValueError("a byte is no token")
                state[open_], matched[open_] = up, self.length[up]
                to[open_] = self.edges.get(up * 256 + byte[open_])
                open_ = open_[to[open_] < 0]
            state, matched = to, matched + 1
            place = np.where((matched == self.length[state]) & (self.token[state] >= 0), state, self.above[state])
            open_ = np.arange(n)
            while len(open_):
                if not place[open_].all():
                    raise ValueError("a byte is no token")
                start = end + 1 - self.length[place[open_]]
                token = self.token[place[open_]]
                good = start == 0
                asked = np.flatnonzero(~good)
                own = open_[asked]
                good[asked] = self.compatible(last[begin[own] + start[asked] - 1].astype(np.int64), token[asked])
                last[spot[open_[good]]] = token[good]
                open_ = open_[~good]
                place[open_] = self.above[place[open_]]
        # Back from the words' ends, then forward.
        found, rest, sizes = [], lengths.copy(), np.zeros(len(words), np.int64)
        own = np.flatnonzero(rest)
        while len(own):
            token = last[begin[own] + rest[own] - 1]
            found.append((own, token))
            sizes[own] += 1
            rest[own] -= self.size[token]
            own = own[rest[own] > 0]
        ids, ends = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes)
        for nth, (own, token) in enumerate(found):
            ids[ends[own] - 1 - nth] = token
        return ids, sizes


    def _encode_alone(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same steps on plain numbers, which cost less than arrays of one element."""
        if self.plain is None:
            kinds = {"edges": self.edges, "rank": self.rank}
            self.plain = {k: dict(zip(t.keys[t.keys >= 0].tolist(), t.values[t.keys >= 0].tolist(), strict=True)) for k, t in kinds.items()}
            self.plain |= {k: getattr(self, k).tolist() for k in ("link", "length", "token", "above", "made", "first", "second")}
        edges, rank, link, length, token, above, made, first, second = (
            self.plain[k] for k in ("edges", "rank", "link", "length", "token", "above", "made", "first", "second")
        )

        def compatible(a: int, b: int) -> bool:
            until = _NEVER
            while rank.get(a * self.n + b, _NEVER) >= until:
                if made[a] > made[b]:
                    until, a = made[a], second[a]
                elif made[b] >= 0:
                    until, b = made[b] + 1, first[b]
                else:
                    return True
            return False

        known: dict[tuple[int, int], bool] = {}
        last, state, matched = [], 0, 0
        for end, byte in enumerate(word, 1):
            while (to := edges.get(state * 256 + byte)) is None:
                state = link[state]
                if state < 0:
                    raise ValueError("a byte is no token")
                matched = length[state]
            state, matched = to, matched + 1
            place = state if matched == length[state] and token[state] >= 0 else above[state]
            while start := end - length[place]:
                if not place:
                    raise ValueError("a byte is no token")
                pair = (last[start - 1], token[place])
                if pair not in known:
                    known[pair] = compatible(*pair)
                if known[pair]:
                    break
                place = above[place]
            last.append(token[place])
        ids, end = [], len(word)
        while end:
            ids.append(last[end - 1])
            end -= int(self.size[ids[-1]])
        return np.array(ids[::-1], dtype=np.uint32)


class Codec:
    """A tokenizer file's encoding and decoding; the file is a byte-level one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cuts, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = spec["normalizer"] is None and cuts["type"] == "ByteLevel" and cuts.get("use_regex", True) and not cuts["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level pair encoding")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("an added token takes more than its own string")
        self.words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if added else lambda text: [text]
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.path, self.ids = path, PartIds(self._parts, list(self.added))

        raw = {i: self._spelled(t) for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        spelled = [raw.get(i, b"") for i in range(max(raw) + 1)] + [b""]
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in spelled], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _spelled(self, token: str) -> bytes:
        return bytes(self.byte[c] for c in token)

    @cached_property
    def pairs(self) -> PairEncoder:
        """Made when something is encoded: a worker that decodes has no need of it."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return PairEncoder({self._spelled(t): i for t, i in model["vocab"].items()}, [(self._spelled(a), self._spelled(b)) for a, b in merges])

    def _parts(self, parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and each part's number of them."""
        words, owner, fixed = [], [], []
        for k, part in enumerate(parts):
            if _ONE_WORD(part):
                words.append(part)
                owner.append(k)
                continue
            for text in self.split(part.decode()):
                if text in self.added:
                    fixed.append((len(words), self.added[text]))
                    words.append(b"")
                    owner.append(k)
                elif text:
                    found = [self._spelled(w) for w, _ in self.words(text)]
                    words += found
                    owner += [k] * len(found)
        ids, sizes = self.pairs.encode(words)
        if fixed:
            place, token = np.array(fixed).T
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[place], token.astype(np.uint32))
            sizes[place] = 1
        return ids, np.bincount(owner, sizes, len(parts)).astype(np.int64)

    def bytes_of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids spell, and where each row's begin; a row's ids begin at its place in ``ends``."""
        ids = np.minimum(ids, len(self.sizes) - 1).astype(np.int64)
        sizes = self.sizes[ids]
        upto = np.r_[0, np.cumsum(sizes)]
        spots = np.repeat(self.begins[ids] - upto[:-1], sizes)
        spots += np.arange(upto[-1])
        return self.spelled[spots], upto[ends]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec of a file, made once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _slots(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of bytes as a column."""
    if kind == pa.string():
        text = data.tobytes()
        try:
            text.decode()
        except UnicodeDecodeError:  # ids can spell anything: what is no UTF-8 is replaced, row by row
            return pa.array([text[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], kind)
        cuts = ends[(ends > 0) & (ends < len(data))]
        if (data[cuts] & 0xC0 == 0x80).any():  # a row's last character goes on in the next row's ids
            return pa.array([text[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], kind)
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids as little-endian unsigned 32-bit integers. ``tokenizer``: a file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for first, end, ids, ends in own.ids.texts(batch.column(1)):
                raw = _slots(ids.astype("<u4").view(np.uint8), 4 * ends, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(ends)), raw], ["doc_id", "n_tokens", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of (doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            ids = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]) if len(ids) else np.zeros(0, np.int64)
            row, upto = 0, np.r_[0, np.cumsum(sizes)]
            while row < len(ids):
                end = max(row + 1, int(np.searchsorted(upto, upto[row] + (4 << 20), side="right")) - 1)
                part = np.frombuffer(b"".join(x.as_py() for x in ids.slice(row, end - row)), dtype="<u4")
                data, ends = own.bytes_of(part, (upto[row : end + 1] - upto[row]) // 4)
                rows = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*rows.columns, _slots(data, ends, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                row = end

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
