"""Exact tokenizer ids at corpus speed: every distinct word goes through the tokenizer once per worker.

Both public vocabularies used here split a text before a space or a line end, and no merge crosses that
cut.  A text is therefore cut into words, unknown words are encoded together in one long string, and the
ids of a text are the joined ids of its words.  Texts with other white space than single spaces and single
line ends go through the tokenizer whole, so the ids always equal those of one plain ``encode`` call.

The cache is bounded: two generations of at most about :data:`CACHE_WORDS` words and :data:`CACHE_BYTES` bytes of words and
ids each.  When the younger is full it becomes the older one, and words that are met again move on to the new generation, so
frequent words stay.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_memory

#: Words of a generation that one Python worker remembers, and their bytes: words, ids and some 160 a word for Python's objects.
CACHE_WORDS, CACHE_BYTES, OBJECTS = 300_000, 64 << 20, 160
#: Longer words are encoded on their own and not remembered.
LONG_WORD = 400
#: Texts with any of these are encoded whole: two spaces or line ends in a row, other white space, white space at an end.
_ODD = "<\\||  |\n\n| \n|\n |[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|^[ \n]|[ \n]$"


#: Marks that are pieces of their own behind a letter or digit in both vocabularies.
_MARKS = ".,!?;:&%$#*|)"

_WORKER: dict[tuple[str, str], "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for the vocabulary file ``path``."""
    found = _WORKER.get(("", path))
    if found is None:
        found = _WORKER[("", path)] = WordEncoder(path)
        release_memory()  # what reading the vocabulary has left behind
    return found


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; it is found on each machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``ids(texts)``: for each text the bytes of its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.held = 0
        ids = self._plain(["a\nb", "a b"])
        self.keeps_space = ids[0] != ids[1]
        if self.keeps_space:
            self.line_end = int(np.frombuffer(self._plain(["\n"])[0], "<u4")[0])
        else:
            import regex

            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Add words to the cache; marks behind a word are looked up apart from it."""
        heads, tailed = {}, []
        for w in new:
            head = w.rstrip(_MARKS)
            if len(head) < len(w) and head and self._last(head).isalnum():
                tailed.append((w, head, w[len(head) :]))
                if head not in self.words:
                    if head in self.older:
                        self.words[head] = self.older[head]
                    else:
                        heads[head] = None
            else:
                heads[w] = None
        if len(self.marks) > CACHE_WORDS:
            self.marks = {}
        unknown = list({t for _, _, t in tailed} - self.marks.keys())
        self.marks.update(zip(unknown, self._plain(unknown), strict=True))
        self._learn_whole(list(heads))
        for w, head, tail in tailed:
            self.words[w] = self.words[head] + self.marks[tail]

    def _learn_whole(self, new: list[str]) -> None:
        alone = [w for w in new if len(w) > LONG_WORD or "<|" in w or not w.strip("\n")]  # also the empty word
        if alone:
            skip = set(alone)
            new = [w for w in new if w not in skip]
            self.words.update(zip(alone, self._plain([w if w[:1] == "\n" or not w or not self.keeps_space else " " + w for w in alone]), strict=True))
        for group in ([w for w in new if w[:1] == "\n"], [w for w in new if w[:1] != "\n"]):
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                self.words.update(zip(part, self._together(part), strict=True))

    def _together(self, part: list[str]) -> list[bytes]:
        if self.keeps_space:  # the line end between the words is an id of its own
            line = part[0][:1] == "\n"
            text = "".join(part) if line else "\n ".join(["", *part])
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(ids == self.line_end)
            ends = np.append(starts[1:], len(ids))
            first = starts if line else starts + 1
        else:  # the last id of each piece of a word is known by its ending
            bare = [w.lstrip("\n") for w in part]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(bare)], add_special_tokens=False)[0].ids, "<u4")
            count = [1 if w.isascii() and w.isalpha() else len(self.pieces.findall(w if w.isascii() else self._lower(w))) for w in bare]
            closing = np.flatnonzero(self.closes[ids])
            last = np.cumsum(count) - 1
            if last[-1] + 1 != len(closing) or min(count) < 1:
                return self._plain(bare)
            ends = closing[last] + 1
            first = np.append(0, ends[:-1])
        if len(first) != len(part):
            return self._plain([w if w[:1] == "\n" or not self.keeps_space else " " + w for w in part])
        raw = ids.tobytes()
        return [raw[a * 4 : b * 4] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]

    def _last(self, word: str) -> str:
        """The character before the marks as the tokenizer sees it: lower-casing may leave a combining mark there."""
        return word[-1] if self.keeps_space or word.isascii() else self._lower(word)[-1]

    @staticmethod
    def _lower(word: str) -> str:
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word))

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.older, self.words, self.held = self.words, {}, 0
        known, older = self.words, self.older
        new = []
        for w in words:
            if w not in known:
                found = older.get(w)
                if found is None:
                    new.append(w)
                else:
                    known[w] = found
        if new:
            self._learn(new)
        self.held += OBJECTS * len(new) + sum(map(len, new)) + sum(len(known[w]) for w in new)
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts (null: empty) and the offsets where each text's ids begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.if_else(odd, "", texts)
        if not self.keeps_space:  # this vocabulary has lower case only
            plain = pc.ascii_lower(plain)
        else:  # no space stands before the first word of a text
            plain = pc.binary_replace_slice(plain.cast(pa.large_binary()), 0, 0, b"\n").cast(pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        words = pc.dictionary_encode(cut.flatten())
        known = self._known(words.dictionary.to_pylist())
        lens = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        codes = words.indices.to_numpy(zero_copy_only=False)
        offsets = np.asarray(cut.offsets, np.int64)
        size = lens[codes]
        ends = np.append(0, np.cumsum(size))
        ids = flat[np.repeat((np.cumsum(lens) - lens)[codes] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[offsets - offsets[0]]
        if self.keeps_space:  # the line end put in front goes again
            keep = np.ones(len(ids), bool)
            keep[at[:-1]] = False
            ids, at = ids[keep], at - np.arange(len(at))
        whole = np.flatnonzero(np.asarray(odd))
        if len(whole):
            parts, last = [], 0
            found = self._plain(texts.take(pa.array(whole)).to_pylist())
            more = np.zeros(len(at), np.int64)
            for i, x in zip(whole.tolist(), found, strict=True):
                parts += [ids[last : at[i]], np.frombuffer(x, "<u4")]
                last, more[i + 1] = at[i], len(x) // 4
            ids, at = np.concatenate([*parts, ids[last:]]), at + np.cumsum(more)
        return ids, at

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
