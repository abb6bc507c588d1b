"""Parts of texts that are encoded many at a time, with the ids that each has on its own."""

import json

import numpy as np
import public_tokenizers
import pytest

from mercantile.llm import parts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [b" word", b"a", b"<", b" <|", b"|>", b"<|endoftext", b"\n", "  é　x".encode(), b"'s", b" ", b"12", b"...", "\U0001f600".encode()]


def alone(encoder, texts):
    return [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def checked(encoder, texts):
    ids, sizes = encoder._encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == alone(encoder, texts)


def test_many_parts_are_one_text_for_the_tokenizer(monkeypatch):
    encoder, texts = token_files.Encoder(PATH), [b" w%d" % k for k in range(500)] + WORDS
    seen, plain = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda some: seen.extend(some) or plain(some))
    checked(encoder, texts)
    assert len(seen) <= len(texts) // 40


@pytest.mark.parametrize("n", [1, 49, 50, 51, 100, 333])
def test_parts_keep_their_ids(n):
    checked(token_files.Encoder(PATH), [WORDS[k % len(WORDS)] + b"x" * (k // len(WORDS)) for k in range(n)])


def test_parts_with_an_added_token_keep_their_ids():
    checked(token_files.Encoder(PATH), [*WORDS, b"<|endoftext|>", b"a<|endoftext|><|endoftext|> b", b"<<|endoftext|>"])


@pytest.mark.parametrize("change", ["two", "within", "truncated"])
def test_tokens_that_cannot_divide_do_not(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    token = spec["added_tokens"][0]
    if change == "two":
        spec["added_tokens"].append(token | {"content": "<|x|>", "id": token["id"] + 1})
    elif change == "within":
        token["content"] = "x-x"
    else:
        spec["truncation"] = {"direction": "Right", "max_length": 8, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    encoder = token_files.Encoder(str(path))
    assert encoder.divider is None
    checked(encoder, [b" x-", b"x-x", b"-x", b" <|x|", b"<|x|>", *WORDS])


def test_texts_are_searched_for_added_tokens_only_if_they_hold_one():
    tried = []

    class Pattern:
        def finditer(self, raw):
            tried.append(raw)
            return parts.pattern_of(["<|a|>"]).pattern.finditer(raw)

    added = parts.pattern_of(["<|a|>"])._replace(pattern=Pattern())
    for text in (b"one <|a two", b"one <|a|> two"):
        data = np.frombuffer(text, np.uint8)
        cut, _ = parts.cut(data, np.array([0, len(data)]), added)
        assert (b"<|a|>" in cut.to_pylist() or b" <|a|>" in cut.to_pylist()) == (b"|>" in text)
    assert tried == [b"one <|a|> two"]
