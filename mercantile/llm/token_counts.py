"""Token counts of a unigram vocabulary, without making tokens.

A text is cut into words at blanks; each word begins with the mark U+2581, which stands for its blank (a text that does not
begin with a blank gets one). For each word an Aho-Corasick automaton enumerates all vocabulary pieces by their end, and
dynamic programming keeps, for every place, the best score and the number of pieces of the path that has it. Rules of the
tokenizer, kept exactly: of equal scores the piece that starts earlier wins; a character that is no piece costs the
least score less 10; consecutive unknown characters are one run. A run is one token, or, if the vocabulary has a piece for every byte
(<0x00> to <0xFF>), as many tokens as its UTF-8 has bytes.

Pieces and scores are those of a public model file, or of any list of (piece, score).

Defined results: NULL and empty texts have 0 tokens. Each row is counted by itself, repeated ones too; very long texts are counted whole;
an empty table gives no rows; other columns are not looked at. Words recur, so a worker remembers counts of a bounded number of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm.recall import Recent

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_HALF = 300_000


def model_pieces(path: str) -> list[tuple[str, float]]:
    """The vocabulary of a model file with its scores, unknown piece first; bytes are pieces too, control and unused ones are not."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in [model.unk_id(), *own]]


class Counter:
    """Counts of one vocabulary; its first piece is the unknown one."""

    def __init__(self, pieces: list[tuple[str, float]], half: int = _HALF):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_byte = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.machine = ahocorasick.Automaton()
        for k, (piece, score) in reversed(list(enumerate(pieces))):  # of a piece that is listed twice the first counts
            self.machine.add_word(piece, (len(piece), score, k == 0))
        self.machine.make_automaton()
        self.words = Recent(self.word, half)

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of one word with its mark."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, piece in self.machine.iter(word):  # at one end the longest first
            ends[end + 1].append(piece)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        # Of a prefix that ends in unknown characters: the place where their run begins (from 1), and its bytes.
        size = [0] * (n + 1)
        for end in range(1, n + 1):
            best, start, single, is_unknown, spelt = None, end - 1, False, True, False
            for length, gain, of_unknown in ends[end]:
                single |= length == 1
                if best is None or gain + score[end - length] > best:
                    best, start, is_unknown, spelt = gain + score[end - length], end - length, of_unknown, of_unknown
            if not single and (best is None or self.unknown + score[end - 1] > best):
                best, start, is_unknown, spelt = self.unknown + score[end - 1], end - 1, True, False
            score[end] = best
            if not is_unknown:
                count[end] = count[start] + 1
                continue
            run[end] = run[start] or start + 1
            size[end] = (size[start] if run[start] else 0) + len(word[start:end].encode())
            # A run that is the unknown piece itself is that piece.
            alone = spelt and not run[start]
            count[end] = count[run[end] - 1] + (1 if alone or not self.by_byte else size[end])
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace(MARK, " ").split(" ")
        if not parts[0]:
            del parts[0]
        found = list(map(self.words.__getitem__, [MARK + p for p in parts]))
        self.words.trim()
        counts, scores = zip(*found, strict=True)
        return sum(counts), math.fsum(scores)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str | list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens, score) of every row. ``vocabulary``: a model file that every executor has, or pieces with scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(vocabulary, str):
            if vocabulary not in _COUNTERS:
                _COUNTERS[vocabulary] = Counter(model_pieces(vocabulary))
            counter = _COUNTERS[vocabulary]
        else:
            counter = Counter(vocabulary)
        for batch in batches:
            found = [counter.text(x.as_py()) for x in batch.column(1)]
            counts, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, score double")
