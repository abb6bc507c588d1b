"""Small documents with every awkward case, and plain versions of the operators' results."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, of string, text_ string, place int, size int, ref long"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark):
    """Prose with copies, near copies, shared passages and edits; NULLs, empty, blank, very long and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(55), "this very line is met in many of the documents"
    texts = []
    for k in range(60):
        words = prose(rng.randint(20, 120)).split(" ")
        if k % 4 == 0:
            words[7:7] = passage.split(" ")
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        if k % 3 == 0:
            edit = rng.randrange(len(line))
            lines.insert(1, line[:edit] + rng.choice(["", "é", "x"]) + line[edit + (k % 2) :])
        texts.append("\n".join(lines))
    texts += texts[:6]  # exact copies
    for text in texts[10:16]:
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, None, "", "", " \n\t ", "!!", "!!", "one", "One.", "a b", "日本 語 テキスト", "a  b\n\n c", prose(6000), "x\n" * 300, "\n", "x" * 20000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "another text under the same number " * 4), (None, texts[0]), (None, None)]
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "é", "B"][k % 5], len(t or ""), "of", "t", 1, 2, 3) for k, (i, t) in enumerate(rows)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def windows_removed(rows, window=13):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    first, out = {}, []
    for i, text in rows:
        words = BLANKS.findall(text or "")
        for k in range(len(words) - window + 1):
            if i is not None:
                run = tuple(words[k : k + window])
                first[run] = min(first.get(run, i), i)
    for i, text in rows:
        words = BLANKS.findall(text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(words) - len(kept), sha(" ".join(kept))))
    return out


def contamination(rows, items, window=10):
    known = {}
    for item, text in items:
        words = LETTERS.findall(lower(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            known.setdefault(tuple(words[k : k + size]), set()).add(item)
    out = []
    for i, text in rows:
        words, hit, met = LETTERS.findall(lower(text)), set(), set()
        for size in {len(x) for x in known}:
            for k in range(len(words) - size + 1):
                if (run := tuple(words[k : k + size])) in known:
                    hit |= set(range(k, k + size))
                    met |= known[run] - {None}
        out.append((i, len(words), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit)))
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def lines_removed(rows, least=16):
    """For rows whose doc_ids differ or are NULL."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= least:
                first.setdefault(line, (i, k))
    gone = {a for a in first for b in first if first[b] < first[a] and one_edit(a, b)}
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for k, x in enumerate(lines) if i is None or len(x) < least or (first[x] == (i, k) and x not in gone)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def bag(text, shingle=5):
    words = LETTERS.findall(lower(text))
    return Counter(tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)) if len(words) >= shingle else Counter([tuple(words)] if words else [])


def classes(rows, least=0.8):
    """Smallest doc_id of each row's component, with the row's index."""
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            near = 5 * shared >= 4 * all_ if all_ else bool(rows[a][1]) and rows[a][1] == rows[b][1]
            if near:
                root[find(a)] = find(b)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(least_id.get(find(k), i), i)
    return [(i, least_id.get(find(k))) for k, (i, _) in enumerate(rows)]


def token_rows(rows, tokenizer, end=2):
    """(doc_id, start, n_tokens, ids_crc32): rows without doc_id first, equal doc_ids by text."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
