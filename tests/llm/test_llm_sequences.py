"""Alignment, periodic runs and language identification against brute force and held-out accuracy, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldaudit.llm import align, language, queries, runs
from fieldaudit.llm.tokens import vocabulary
from fieldaudit.session import ship

DOCS = "doc_id long, text string, lang string, slice long, runs int, n_a string, score double"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a documents table of odd texts, repeated rows, null ids and clashing columns."""
    rng = random.Random(7)
    signs = list("aabcdeEzİßéñ漢字😀 \n  \n..,!?'\"1234<|>▁\t\r\x0b\x1c\x85\xa0 ​　﻿́") + ["<|endoftext|>", "</s>", "<0x0A>", " the", "ing", "\n\n"]
    texts = [None, "", " ", "\n", "  ", "▁", "one", "é", "漢字 漢字", "</s>[INST] <|endoftext|> x", "12 34 !!"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    vocabulary_ = {"en": "the of and to in is that for was with", "de": "der die und das von nicht ein mit auf", "fr": "le la des est les une que pour dans"}
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, None))
    for i in range(240):
        lang = rng.choice(list(vocabulary_))
        own = vocabulary_[lang].split()
        rows.append((1000 + i, " ".join(rng.choice(own) + rng.choice(["", ",", ""]) for _ in range(rng.randrange(1, 60))), rng.choice([lang, lang, lang, "", None])))
    rows.append((5000, " ".join(rng.choice("abc") for _ in range(4000)) + " x y z" * 300, "en"))
    rows += [(None, "a b " * 20, "en"), rows[20], rows[20], rows[200]]
    out = tmp_path_factory.mktemp("sequences")
    spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows], DOCS).repartition(7).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{out}/none/documents.parquet")
    return str(out)


def read(spark, tables):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, tables):
    for name in ("op11_align", "op12_runs", "op13_language"):
        assert queries.QUERIES[name](spark, f"{tables}/none").count() == 0


def plain_tokens():
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    symbol = align.byte_symbols()
    bytes_a = {i: bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t, i in a.get_vocab().items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(i) for i in range(b.get_piece_size()))]

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        found = [[(i, table[i]) for i in side] for side, table in zip(ids, (bytes_a, bytes_b), strict=True)]
        return found if all(b"".join(t for _, t in f) == (" " + text).encode() for f in found) else ([], [])

    return tokens


def test_align(spark, tables):
    docs, tokens = read(spark, tables), plain_tokens()
    linked, held = [], collections.Counter()
    for _, text in docs:
        spans = []
        for side in tokens(text):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = [(i, j) for i, x, y in spans[0] for j, u, v in spans[1] if x < v and u < y] if len(spans[0]) < 3000 else sweep(*spans)
        cuts = sorted({y for _, _, y in spans[0]} & {v for _, _, v in spans[1]})
        groups, x = [], 0
        for y in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in s if x < e <= y) for s in spans))
            x = y
        linked.append((spans, links, groups))
        held.update(set(links))
    top = collections.Counter()
    for (i, _), c in held.items():
        top[i] = max(top[i], c)
    want = [
        (d, len(s[0]), len(s[1]), len(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (d, _), (s, k, g) in zip(docs, linked, strict=True)]
    assert rows_of(queries.QUERIES["op11_align"](spark, tables)) == sorted(want, key=repr)


def sweep(a, b):
    out, j = [], 0
    for i, x, y in a:
        while b[j][2] <= x:
            j += 1
        k = j
        while k < len(b) and b[k][1] < y:
            out.append((i, b[k][0]))
            k += 1
    return out


def test_shared_cuts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.choice(end, rng.integers(0, end), replace=False) + 1, end)) for _ in range(2))
        one = lambda n: np.array([n])
        cuts_a, cuts_b = align.shared_cuts(a, b, one(0), one(len(a) - 1), one(0), one(len(b) - 1))
        assert a[cuts_a].tolist() == b[cuts_b].tolist() == np.intersect1d(a, b).tolist()


def all_runs(words, least):
    """Runs by trying every period."""
    n, out, code = len(words), [], {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length < max(least, 2 * q) or any(q % p == 0 and (w[a : a + length - p] == w[a + p : a + length]).all() for p in range(1, q)):
                continue
            out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_squares():
    rng = random.Random(2)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 50)
        words = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.5:
            p, s = rng.randrange(1, 8), rng.randrange(n)
            words = words[:s] + (words[s : s + p] * 50)[: n - s] + [str(rng.randrange(k)) for _ in range(rng.randrange(9))]
        for least in (2, 5, 12):
            assert runs.runs_of([words, words[3:]], least) == [all_runs(words, least), all_runs(words[3:], least)]


def test_one_word_repeated():
    assert runs.runs_of([["a"] * 50_000, ["a", "b"] * 20_000]) == [[(0, 50_000, 1)], [(0, 40_000, 2)]]


def test_runs(spark, tables):
    want = []
    for doc, text in read(spark, tables):
        words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = all_runs(words, 12)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((
            doc, len(found), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sum(r[1] for r in want) > 20
    assert rows_of(queries.QUERIES["op12_runs"](spark, tables)) == sorted(want, key=repr)


def test_language(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op13_language"](spark, tables).collect():
        got[r["doc_id"]].append(r)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0

    def vector(text):
        out = np.zeros(language.DIMENSIONS)
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            w = f" {word} "
            for k in range(len(w) - 2):
                v = [language.letter_vector(ord(c)).astype(float) for c in w[k : k + 3]]
                out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out / max(np.sqrt(out @ out), 1e-9)

    sums = collections.defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for r in docs:
        if r["lang"] and r["doc_id"] is not None and not held(r["doc_id"]):
            sums[r["lang"]] += vector(r["text"])
    names = sorted(sums)
    unit = np.array([sums[n] / np.sqrt(sums[n] @ sums[n]) for n in names])
    right = total = 0
    for r in docs:
        out = [o for o in got[r["doc_id"]]]
        assert {o["held_out"] for o in out} == {held(r["doc_id"])}
        v = vector(r["text"])
        if not v.any():
            assert any((o["lang_pred"], o["score"]) == ("und", 0.0) for o in out)
            continue
        cosine = unit @ v
        assert any(abs(o["score"] - max(0.0, cosine.max())) < 1e-4 for o in out)
        if np.sort(cosine)[-1] - np.sort(cosine)[-2] > 1e-4:
            assert any(o["lang_pred"] == names[int(cosine.argmax())] for o in out)
        if r["lang"] and held(r["doc_id"]):
            total, right = total + 1, right + (out[0]["lang_pred"] == r["lang"])
    assert total > 20 and right / total > 0.9


def test_language_refuses_other_columns(spark):
    many = spark.createDataFrame([(i, "a", f"l{i}") for i in range(3 * language.LANGUAGES)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.fit(many)


def test_letter_vectors_are_near_orthogonal():
    rows = np.array([language.letter_vector(c) for c in range(97, 123)]).astype(int)
    cosine = rows @ rows.T / language.DIMENSIONS
    assert np.abs(cosine - np.eye(26)).max() < 0.15
