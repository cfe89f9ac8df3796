"""Whole-text encoding with the tokenizers library and a bounded memory of chunks.

Two kinds of public vocabularies cut a text at places that can be told without the vocabulary:

* byte level with the usual pattern: a match ends before each blank that a non-blank follows, and the
  pattern never looks behind; so the text can be cut before each such blank;
* white space dropped: no match holds a blank, so the text can be cut at blanks and line ends.

The ids of a text are the ids of its chunks, in order. Chunks repeat far more than texts do, so their ids
are remembered, in two generations of bounded size. Many texts are cut, and their chunks joined again, in Arrow (encode_each), so that Python sees a chunk once
for a group of texts, and the marks after a word apart from it. Any other tokenizer gets the whole text, and so does a text that holds one
of the vocabulary's own added tokens (such as an end-of-text marker), which the library makes one id of. Where a text must not be able to
make such an id (chat formatting), a literal encoder reads them as any other characters.
Tests compare all of it with plain calls of the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")
_UNEVEN = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]|[ \n]{2}")
_ODD = ["  ", " \n", "\n ", "\n\n", *"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_TAIL = ".,;:!?*$%&#|()[]{}<>\"/+=-_@~^"
_GENERATION = 250_000
#: The same where words are remembered without the marks after them.
_WORDS = 160_000
_LONGEST = 200
#: Words of letters whose bytes and lower case no library takes for anything else: they are one piece of any text, so the vocabulary's model alone gives their ids.
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The same letters, and the blank that a word may have before it.
_BEFORE_TAIL = " " + "".join(c for c in map(chr, range(256)) if _LATIN.fullmatch(c))
#: Bytes of texts that are cut together; a longer text is cut alone.
_GROUP = 1 << 20
_TOKEN_ID = attrgetter("id")
_encoders: dict[tuple[str, bool], "ChunkEncoder"] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, literal: bool = False) -> "ChunkEncoder":
    """One encoder a Python worker, kept between tasks. name: a public vocabulary's name, or a path. literal: added tokens in texts
    are plain characters; else ids are the library's own."""
    if (name, literal) not in _encoders:
        _encoders[name, literal] = ChunkEncoder(name if os.path.sep in name else vocabulary(name), literal)
    return _encoders[name, literal]


class ChunkEncoder:
    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = literal
        self.model = self.plain.model
        added = spec.get("added_tokens") or []
        self.added = [] if literal else [t["content"] for t in added]
        pre = spec.get("pre_tokenizer") or {}
        norm = json.dumps(spec.get("normalizer"))
        steps = pre.get("pretokenizers") or [pre]
        self.mode = "whole"
        if any(t["normalized"] or not t["special"] for t in added):
            pass  # found in normalised texts, or whatever the setting
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null":
            self.mode = "prefix"
        elif steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s\\p{L}\\p{N}" in json.dumps(steps[0]).replace("\\\\", "\\"):
            self.mode = "dropped"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.plain.get_vocab_size(with_added_tokens=True)
        names = [self.plain.id_to_token(i) or "" for i in range(size)]
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.ends = np.array([x.endswith("</w>") for x in names])
        # byte-level vocabularies write each byte as a character: itself where it can be seen, else the next one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.written = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def _ids(self, text: str) -> np.ndarray:
        """The library's ids; its fast call leaves out the spans, which nothing here reads."""
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _one(self, chunk: str) -> bytes:
        return self._ids(chunk).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words of letters alone, a blank before each or not: Latin ones by the model, the others by one call for many words, cut by the
        bytes that the ids stand for, or by the ids that end a word."""
        prefix, tokenize, written, others = self.mode == "prefix", self.model.tokenize, self.written, []
        own, ids, ends = [], [], [0]
        for w in words:
            if w.isascii():  # letters alone
                plain = ("\u0120" + w[1:] if w[0] == " " else w) if prefix else w.lower()
            elif not _LATIN.fullmatch(w, 1 if w[0] == " " else 0):
                others.append(w)
                continue
            else:
                plain = (w if prefix else w.lower()).encode().decode("latin-1").translate(written)
            own.append(w)
            ids.extend(map(_TOKEN_ID, tokenize(plain)))
            ends.append(4 * len(ids))
        data = array("I", ids).tobytes()
        self.young.update((w, data[x:y]) for w, (x, y) in zip(own, pairwise(ends), strict=True))
        words = others
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = self._ids(("" if self.mode == "prefix" else " ").join(part))
            if self.mode == "prefix":
                ends = np.cumsum(self.sizes[ids])
                want = np.cumsum([len(w.encode()) for w in part])
                cuts = np.searchsorted(ends, want)
                good = len(ends) > 0 and cuts[-1] == len(ids) - 1 and (ends[cuts] == want).all()
            else:
                cuts = np.flatnonzero(self.ends[ids])
                good = len(cuts) == len(part)
            if not good:
                self.young.update((w, self._one(w)) for w in part)
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(part, (4 * (cuts + 1)).tolist(), strict=True):
                self.young[w] = data[start:end]
                start = end

    def chunks(self, text: str) -> list[str]:
        if self.mode == "dropped":
            return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
        if any(x in text for x in _ODD) or not text.isascii() and _UNEVEN.search(text):
            first, *rest = _CUT.split(text)
            return [first, *[" " + x for x in rest]]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _add(self, chunks: list[str]) -> None:
        """Remembers what is new: a word of letters as it is; with marks after it, the word and the marks apart, as no match holds
        both; anything else alone."""
        young, old, words, joint = self.young, self.old, {}, []
        prefix = self.mode == "prefix"
        for c in chunks:
            if (kept := old.get(c)) is not None:
                young[c] = kept
                continue
            word = c.rstrip(_TAIL)
            if (word[1:] if prefix and word[:1] == " " else word).isalpha():
                if len(word) == len(c):
                    words[c] = None
                    continue
                if word not in young:
                    if (kept := old.get(word)) is not None:
                        young[word] = kept
                    else:
                        words[word] = None
                joint.append((c, word, c[len(word) :]))
            else:
                young[c] = self._one(c) if c else b""
        self._learn(list(words))
        for c, word, tail in joint:
            if (end := young.get(tail)) is None:
                end = young[tail] = self._one(tail)
            young[c] = young[word] + end

    def _holds_added(self, text: str) -> bool:
        """Also where lower-casing, which chunks do before the library sees them, would make an added token."""
        return any(t in text for t in self.added) or self.mode == "dropped" and (low := text.lower()) != text and any(t in low for t in self.added)

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.mode == "whole" or self._holds_added(text):
            return self._one(text)
        chunks = self.chunks(text)
        if max(map(len, chunks)) > _LONGEST:  # a chunk of endless length is not remembered
            out = []
            for c in chunks:
                if len(c) > _LONGEST:
                    out.append(self._one(c))
                else:
                    if c not in self.young:
                        self._add([c])
                    out.append(self.young[c])
            return b"".join(out)
        return self._joined(chunks)

    def _joined(self, chunks: list[str]) -> bytes:
        if new := set(chunks).difference(self.young):
            self._add(list(new))
        out = b"".join(map(self.young.__getitem__, chunks))
        if len(self.young) > _GENERATION:
            self.old, self.young = self.young, {}
        return out

    def encode_each(self, texts: pa.Array) -> Iterator[bytes]:
        """encode_bytes of each text, none of them null, in order."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + _GROUP, "right")))
            group = texts.slice(at, end - at)
            plain = group.to_pylist()
            even = [self.mode != "whole" and len(t) <= _GROUP and not self._holds_added(t) for t in plain]
            if self.mode == "prefix":  # where the pattern alone tells the places to cut at
                even = pc.and_(pa.array(even), pc.invert(pc.match_substring_regex(group, _UNEVEN.pattern))).to_pylist()
            found = iter(self._together(group.filter(pa.array(even))) if any(even) else [])
            for t, together in zip(plain, even, strict=True):
                yield next(found) if together else self.encode_bytes(t)
            at = end

    def _together(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that can be cut at each blank and line end. Marks after a word of Latin letters are looked up apart from it."""
        if self.mode == "dropped":
            low = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
            cut = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary
        words = pc.ascii_rtrim(chunks, _TAIL)
        latin = pc.and_(pc.equal(pc.utf8_ltrim(words, _BEFORE_TAIL), ""), pc.invert(pc.is_in(words, pa.array(["", " "], words.type))))
        parts = []
        for part in (pc.if_else(latin, words, chunks), pc.if_else(latin, pc.utf8_ltrim(chunks, _BEFORE_TAIL), "")):
            own = part.dictionary_encode()
            names = own.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = list(map(self.young.get, names))
            if new := [k for k, x in enumerate(ids) if x is None]:
                self._add([c for k in new if len(c := names[k]) <= _LONGEST])
                for k in new:
                    ids[k] = x if (x := self.young.get(c := names[k])) is not None else self._one(c)  # what is too long is not remembered
            parts.append(pa.array(ids, pa.binary()).take(own.indices))
        joined = pc.binary_join_element_wise(*parts, b"").take(coded.indices)
        if len(self.young) > _WORDS:
            self.old, self.young = self.young, {}
        places, data = np.frombuffer(joined.buffers()[1], "<i4"), joined.buffers()[2]
        return [data[x:y].to_pybytes() if x < y else b"" for x, y in pairwise(places[cut.offsets.to_numpy()].tolist())]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id of a byte-level vocabulary stands for."""
        return self.sizes
