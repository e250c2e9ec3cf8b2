"""Operators of the training-data pipeline against brute force, round trips and held-out accuracy, with odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldaudit.llm import chat, decontaminate, fingerprints, grams, html_text, ngram_join, packing, quality, token_files, tokens, toxicity, warc
from fieldaudit.llm.common import shared_dir
from fieldaudit.session import ship
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, b string, p int, score double, sig long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def words(rng, n, k=40):
    return " ".join(f"w{rng.randrange(k)}{rng.choice(['', ',', '.', chr(10)])}".strip("\n") for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", " ", "\n\n", "one", "one two", "One TWO three four five", "a" * 3000, "É ß 漢字 😀 x", "<|endoftext|> a\tb"]
    for _ in range(12):
        base = words(rng, rng.randrange(20, 90), 500).split(" ")
        out.append(" ".join(base))
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = f"n{rng.randrange(9999)}"
            out.append(" ".join(near) + rng.choice(["", " tail", " more and more words here"]))
    out.append(words(rng, 9000, 3000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None, "x", 1, 2.0, 5) for i, t in enumerate(texts())]
    rows += [(None, "no id here at all", "x", None, None, None, None), rows[6], rows[12]]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = tokens.vocabulary("byte_bpe_50k.json")
    out = shared_dir(spark, "t")
    token_files.write_tokens(none, out, path, 2)
    assert token_files.checksums(token_files.read_tokens(spark, out)).count() == 0
    assert packing.pack(none, path).count() == 0
    assert ngram_join.ngram_components(none).count() == 0
    assert fingerprints.compare_versions(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


def test_word_ids_equal_plain_encoding():
    rng = random.Random(11)
    signs = list("aAbcİIıßéÉ漢字ǅﬁK①²½٠ \n .,!?:;'\"&%$#*|)(-_<>12") + ["İ:", "İ;", "i̇", "’s", "'LL", "<|endoftext|>", " the", "ẞ", "İ̧"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = tokens.WordEncoder(tokens.vocabulary(name))
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(6000)]
        assert encoder.ids(texts) == encoder._plain(texts)


def test_small_word_caches_give_the_same_ids(monkeypatch):
    some = [words(random.Random(k), 60, 400) for k in range(40)]
    encoder = tokens.WordEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "CACHE_BYTES", 5000)
    assert [encoder.ids([t]) for t in some] == [encoder._plain([t]) for t in some] and len(encoder.words) < 200


def test_fingerprints(docs):
    piece = re.compile(r"[^\n]{1,100}[^.!?\n]{0,120}[.!?\n]*|\n+")
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = collections.defaultdict(list)
    for r in fingerprints.compare_versions(docs).collect():
        got[r["doc_id"]].append(r)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        own, new, nxt = (set(piece.findall(x)) for x in (t, edited, after))
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(own, new), near(own, nxt))
        match = [r for r in got[i] if (r["n_chars"], r["edited_sha256"]) == want[:2] and abs(r["near_edited"] - want[2]) < 1e-9 and abs(r["near_next"] - want[3]) < 1e-9]
        assert match, (i, want, got[i])
        for r in match:
            assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert sum(map(len, got.values())) == len(rows)


def test_sketch_failures_are_retried(spark):
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda x: F.xxhash64(x)).alias("a"), F.transform(F.sequence(F.lit(300), F.lit(900)), lambda x: F.xxhash64(x)).alias("b"))
    cells = lambda c: fingerprints.sketch(fingerprints._signed(F.col(c), 1), 0)
    r = d.select(fingerprints.difference(F.col("a"), F.col("b"), cells("a"), cells("b")).alias("d"), "a", "b").first()
    assert {(x["d"], x["s"]) for x in r["d"]} == {(x, 1) for x in set(r["a"]) - set(r["b"])} | {(x, -1) for x in set(r["b"]) - set(r["a"])}
    assert len(r["d"]) == 299 + 500


def test_decontamination(spark):
    rng = random.Random(4)
    item = [f"t{rng.randrange(9999)}" for _ in range(40)]
    short = [f"s{i}" for i in range(9)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    fill = lambda n: [f"f{rng.randrange(9999)}" for _ in range(n)]
    rows = [
        (1, " ".join(fill(50) + item + fill(50))), (2, " ".join(fill(5) + changed).upper()), (3, " ".join(fill(200))), (4, " ".join(item[:12] + fill(60))),
        (5, " ".join(item[3:33])), (6, None), (7, ""), (8, " ".join(fill(3) + short + fill(3))), (9, ", ".join(item)), (9, ", ".join(item)), (None, " ".join(item)), (10, " ".join(fill(30) * 900))]
    bench = [(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, ""), (5, "a b c"), (6, " ".join(short)), (None, "x y")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string").withColumn("p", F.lit(2)))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == {(d, i) for d in (1, 2, 5, 9, None) for i in (1, 2)} | {(8, 6)}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_SEEDS, 40])
def test_cut_and_regularly_changed_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", block)
    rng = random.Random(5)
    fill = lambda n: [f"f{rng.randrange(9999)}" for _ in range(n)]
    item, shared = [f"t{i}" for i in range(40)], [f"u{i}" for i in range(30)]
    bench = {1: item, 2: shared + fill(20), 3: fill(20) + shared, 4: ["w"] * 300, 5: [f"v{i}" for i in range(16)]}
    rows, want = [], set()

    def add(words, *items):
        want.update((len(rows), i) for i in items)
        rows.append((len(rows), " ".join(words)))

    for n in range(10, 20):  # verbatim passages: found from RUN tokens on, wherever they stand in the item
        for at in (0, 7, 40 - n):
            add(fill(30) + item[at : at + n] + fill(30), *([1] if n >= decontaminate.RUN else []))
    for k in range(4):  # every fourth token replaced
        add(fill(9) + [w if i % 4 != k else "x" for i, w in enumerate(item)] + fill(9), 1)
    for k in range(4):
        add(fill(9) + [w if i % 4 != k else "x" for i, w in enumerate(bench[5])], 5)
    add(fill(9) + [w if i % 3 else "x" for i, w in enumerate(item)] + fill(9))  # two of three agree: no evidence
    add(fill(3) + shared + fill(3), 2, 3)
    add(["w"] * 50, 4)
    got = decontaminate.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in bench.items()], "item_id long, text string"))
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, num, tile", [(4, 85, 2048), (5, 80, 4)])
def test_ngram_components(docs, monkeypatch, n, num, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    want = brute_components([r for r in pairs(docs) if r[0] is not None], n, num, 100)
    got = ngram_join.ngram_components(docs, n, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len(got) == docs.count() and sum(v[1] != k for k, v in want.items()) > 20


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            x, y = (ngram_join._bitmaps(s, np.array([0, len(s)]))[0] for s in (a, b))
            assert ngram_join.may_reach(x, len(a), y, len(b), 85, 100)


def test_bitmaps_grow_as_the_threshold_falls():
    """At 80 % a bit an element let four times the pairs of a large group of near copies pass."""
    assert [ngram_join.bits_for(k, 100) for k in (90, 85, 80, 50)] == [1, 1, 2, 4]
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:430], rng.integers(0, 1 << 62, 70).astype(np.uint64)]))  # 430 of 570 shared
    x, y = (ngram_join._bitmaps(s, np.array([0, len(s)]), ngram_join.bits_for(80, 100))[0] for s in (a, b))
    assert not ngram_join.may_reach(x, len(a), y, len(b), 80, 100)


def test_bitmaps_are_small_and_tell_sets_apart():
    """Bitmaps of four to eight bits an element were most of the shuffle, and of its growth."""
    rng = np.random.default_rng(3)
    for size in (70, 300, 1000, 5000):
        a, other = (np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: size * 7 // 10], other[: size * 3 // 10]]))
        maps = [ngram_join._bitmaps(s, np.array([0, len(s)]))[0] for s in (a, b, other)]
        assert all(8 * len(m) <= max(64, 2 * size) for m in maps)
        assert not ngram_join.may_reach(maps[0], len(a), maps[2], len(other), 85, 100)
        assert not ngram_join.may_reach(maps[0], len(a), maps[1], len(b), 85, 100)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_equal_the_tokenizer(name):
    enc = tokens.WordEncoder(tokens.vocabulary(name))
    odd = [t or "" for t in texts()] + ["a\n\nb  c", " x", "y ", "don't we'll 12a34 ok", "İstanbul ΣΑΣ é x", "a b", "a\x1cb", "tab\tx", "½ a_b --", "</s>[INST] ok", "<|ENDOFTEXT|> x", "a, b.) c!!! x2. ½. __. a_. é,", "İ K.", "a!!! b?!"]
    for _ in range(2):
        assert enc.ids(odd) == enc._plain(odd)


def test_token_files(spark, docs):
    path = tokens.vocabulary("word_bpe_49k.json")
    enc = tokens.WordEncoder(path)
    out = shared_dir(spark, "t")
    token_files.write_tokens(docs, out, path, 2)
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = enc._plain([t])[0] + np.uint32(2).tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = token_files.checksums(token_files.read_tokens(spark, out))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    span = token_files.read_span(spark, out, want[20][1] + 1, 3)
    assert {r["doc_id"] for r in span.collect()} == {i for i, s, n, _ in want if s < want[20][1] + 4 and s + n > want[20][1] + 1}
    assert token_files.read_tokens(spark, out, F.col("doc_id") == 12).count() == 1


def test_packing(docs):
    path = tokens.vocabulary("byte_bpe_50k.json")
    enc = tokens.WordEncoder(path)
    own = collections.Counter((i, enc._plain([t])[0] + np.uint32(0).tobytes()) for i, t in pairs(docs))
    rows = packing.pack(docs, path, 0, 64).collect()
    sequences, whole = collections.defaultdict(list), collections.defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]] += r["length"]
        assert any(i == r["doc_id"] and len(b) // 4 == r["doc_tokens"] and zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for i, b in own)
    lengths = collections.defaultdict(int)
    for (i, b), k in own.items():
        lengths[i] += k * len(b) // 4
    assert whole == lengths
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 64) for _ in range(500)), reverse=True)
    _, cost = packing.assign(lengths, 64, 1.0, 1 / 64)
    full = cost[: sum(lengths) // 64]
    assert np.std(full) < 0.2 * np.mean(full)


def labelled(spark, n=700):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = words(rng, rng.randrange(30, 80), 300).split(" ")
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Grumbel,", "snark", "FLOP.", "wretchy"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "x"), (n + 2, "word " * 30000)]
    labels += [(n + 1, None, None), (None, 1, 1), (3, labels[3][1], labels[3][2])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind, target, mod, held, most", [(quality, "quality", 5, 0, 0.02), (toxicity, "toxic", 3, 1, 0.08)])
def test_classifiers_on_held_out_rows(spark, kind, target, mod, held, most):
    docs, labels = labelled(spark)
    rows = kind.score(docs, kind.fit(docs, labels)).join(labels.distinct(), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and r[target] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in rows if r["doc_id"] is not None)
    assert len(out) > 80 and sum(r["predicted"] != r[target] for r in out) <= most * len(out)


def test_isotonic_is_the_nearest_step_function():
    y, w = np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1.0, 1, 2, 1, 1, 3])
    got = quality.isotonic(y, w)
    assert np.all(np.diff(got) >= -1e-12)
    assert np.allclose(got, [0.1, 1.3 / 4, 1.3 / 4, 1.3 / 4, 3.3 / 4, 3.3 / 4])


def test_pairwise_part_of_the_factorization_machine():
    rng = np.random.default_rng(1)
    m = toxicity.Model(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    own = [np.array([0, 3, 5]), np.array([], int), np.array([8])]
    got = m.raw(np.concatenate(own), np.repeat([0, 1, 2], [3, 0, 1]), 3)
    want = [0.3 + m.weight[t].sum() + sum(m.factor[a] @ m.factor[b] for k, a in enumerate(t) for b in t[k + 1 :]) for t in own]
    assert np.allclose(got, want)


def test_html_on_pages_of_other_layouts(spark):
    cases = [
        ("<article><h1>T &amp; U</h1><p>One  two\n three <b>bo</b>ld<br>x<p>Next</article><footer>&copy; f</footer>", "T & U One two three bold x Next"),
        ('<div id="page"><header><h1>Site</h1><nav><a href=a>A</a><a href=b>B</a></nav></header><main><h2>Head</h2><p>Body text that is long enough to be read.</p><aside class="related"><a href=x>More of it</a></aside><p>End of it, with <a href=y>one link</a> in a sentence.</p></main><section id="comments"><h3>Comments</h3><p>Nice words from a reader of this page.</p></section></div>',
         "Head Body text that is long enough to be read. End of it, with one link in a sentence."),
        ('<body><div class="cookie-banner"><p>We use cookies to do things on this site, really.</p></div><div class="post-content"><p>First words of the story are here.</p><div class="ad-box">Buy now, it is cheap today.</div><p>Second words of the story.</p></div><form><label>Mail</label><input><button>Go</button></form></body>',
         "First words of the story are here. Second words of the story."),
        ("", ""), (None, ""), ("<nav><a>x</a></nav>", ""), ("<!-- c --><script>var t='</p>';</script><style>p{}</style>", ""), ("<p <<>>", None), ("<article><p>" + "long words here " * 20000 + "</article>", ("long words here " * 20000).strip())]
    rows = [(i, None, h) for i, (h, _) in enumerate(cases)] + [(0, None, cases[0][0]), (None, "u", cases[0][0])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = cases[r["page_id"]][1] if r["page_id"] is not None else cases[0][1]
        assert want is None or (r["text"], r["n_chars"]) == (want, len(want)), (r["page_id"], r["text"][:200])


def test_messages_give_exact_marginals():
    page = html_text.Page("<div><p>a b c</p><ul><li>x<li>y</ul></div><p>z</p>")
    forest = html_text.Forest([page])
    rng = np.random.default_rng(0)
    weights, table = rng.normal(size=html_text.FEATURES), rng.normal(size=(html_text.EDGES, 2, 2))
    unary, n = forest.x @ weights, len(page.tag)
    total, mass = np.zeros(n), 0.0
    for s in range(1 << n):
        state = [s >> i & 1 for i in range(n)]
        e = np.exp(sum(unary[i] * state[i] for i in range(n)) + sum(table[forest.edge[i]][state[forest.parent[i]], state[i]] for i in range(1, n)))
        total, mass = total + e * np.array(state), mass + e
    assert np.allclose(html_text.content(forest, weights, table), total / mass)


def test_html_held_out_pages():
    weights, table = html_text.model()
    wrong = every = 0
    for source in html_text.labelled_pages(60, seed=77):
        page = html_text.Page(source)
        p = html_text.content(html_text.Forest([page]), weights, table)
        every += len(page.blocks)
        wrong += sum((p[node] > 0.5) != page.label[node] for node, _ in page.blocks)
    assert wrong <= 0.01 * every


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "a\\b\\\\<\\|x", "[\\INST] <\\s> \\", None, "", "😀<<SYS>>", "<|image:0|>", "x" * 50000]
    part = lambda kind, text=None, ref=None, **k: (kind, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, i, "assistant" if i % 2 else "user", [part("text", s)]) for i, s in enumerate(said)]
    rows += [(2, 0, None, None), (2, None, "system", [part("text", "a"), None, part("image", ref="i.png", width=56, height=29), part("audio", ref="a.wav", seconds=2.0), part("text", "b"), part("document", ref="d.pdf", pages=3), part("odd", ref="o")]), (None, 0, "assistant", [part(None, "t")]), (None, 0, "assistant", [part(None, "t")])]
    data = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("seen", F.lit(1)).repartition(3)
    out = chat.format_chats(data)
    got = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("text")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", s or "") for i, s in enumerate(said)]
    assert got[1]["text"] == "".join(s or "" for s in said[1::2])
    assert [tuple(a)[1:] for a in got[2]["attachments"]] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 50), (4, "document", "d.pdf", 1200), (5, "odd", "o", 0)]
    assert got[2]["formatted"].startswith("<|turn|>system<|text|>a<|image:1|><|audio:2|>b<|document:4|><|attachment:5|><|end|>")
    assert got[None]["text"] == "tt"


def test_warc_round_trip_and_salvage(spark):
    pages = [(3, "http://a b", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "é" * 9), (None, "u", "same"), (6, "u", "z" * 400000), (3, "http://a b", "same")]
    folder = shared_dir(spark, "t")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("x")).repartition(3)
    assert warc.write_warc(frame, folder).agg(F.sum("records")).first()[0] == len(pages)
    got = warc.read_warc(spark, folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    told = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in got)
    want = []
    for i, _, t in pages:
        first = {"same": 1, None: 2, "": 2}.get(t)
        again = i is not None and first is not None and i > first
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{first}>" if again else "", len((t or "").encode()), digest(t)))
    assert told == sorted(want)
    assert warc.quarantine(spark, folder).count() == 0


def test_salvage_goes_on_after_damage():
    one = lambda i: warc.record(i, "u", b"payload %d " % i * 50, warc.base32_sha1(b"payload %d " % i * 50), None)
    members = [warc._member(one(i)) for i in range(6)]
    hurt = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) + len(members[2]) // 2
    hurt[at : at + 20] = b"\x00" * 20
    records, gaps = warc.salvage(bytes(hurt) + b"junk" + one(7) + one(8)[:-40] + one(9))
    ids = [r["record_id"] for r in records]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5, 7, 9)]
    assert gaps[0][:2] == (len(members[0]) + len(members[1]), sum(map(len, members[:3]))) and len(gaps) == 3
    wrong = one(1).replace(b"payload 1", b"payload 2")
    assert warc.salvage(wrong + one(2))[0][0]["record_id"] == "<urn:page:2>"


def test_salvage_goes_on_within_a_member():
    noise = lambda i: b"".join(hashlib.sha512(b"%d %d" % (i, j)).digest() for j in range(2000))
    one = lambda i: warc.record(i, "u", noise(i), warc.base32_sha1(noise(i)), None)
    ids = lambda records: [int(r["record_id"][10:-1]) for r in records]
    wrong = one(2).replace(noise(2)[:9], b"x" * 9)
    member, after = warc._member(one(1) + wrong + one(3) + one(4)), warc._member(one(5))
    records, gaps = warc.salvage(member + after)
    assert ids(records) == [1, 3, 4, 5] and {r["offset"] for r in records} == {0, len(member)}
    assert gaps == [(0, len(member), f"payload digest differs (bytes {len(one(1))} to {len(one(1) + wrong)} of the inflated member)")]
    short = one(2).replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(one(2)) - one(2).index(b"HTTP") - 4), b"Content-Length: 7\r\n\r\nHTTP")
    assert short != one(2) and ids(warc.salvage(warc._member(one(1) + short + one(3)))[0]) == [1, 3]

    whole = warc._member(b"".join(map(one, range(5))))
    cut = len(whole) * 7 // 10
    records, gaps = warc.salvage(whole[:cut])
    assert ids(records) == [0, 1, 2] and len(gaps) == 1 and 0 < gaps[0][0] < gaps[0][1] == cut
    records, gaps = warc.salvage(whole[:cut] + after)
    assert ids(records) == [0, 1, 2, 5] and gaps[-1][1] == cut
    torn = whole[:-8] + b"\x00" * 8
    records, gaps = warc.salvage(torn + after)
    assert ids(records) == [0, 1, 2, 3, 4, 5] and gaps[-1][1] == len(torn)

    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(b"".join(warc.record(i, "u", b"p%d" % i, warc.base32_sha1(b"p%d" % i), None) for i in range(9))) + stored.flush()
    assert ids(warc.salvage(stored[:-8])[0]) == list(range(9))


def test_words_and_shingles():
    t = pa.array(["A b\tc\x0bd", None, "", "é x", "  q  "])
    w = grams.words(t)
    assert np.diff(w.at).tolist() == [4, 0, 0, 2, 1]
    same = grams.words(pa.array(["a B C d"]))
    assert same.hash.tolist() == w.hash[:4].tolist()
    s, at = grams.shingles(w, 3)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 1] and len(set(s.tolist())) == 4
