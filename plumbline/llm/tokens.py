"""Token ids of whole texts, with a memory of words already encoded.

The library's own pipeline spends most of its time on normalising and splitting. For a tokenizer whose
steps are known, many texts at once are split here by array operations on their bytes, and only words not
met before reach the library's BPE model. Two kinds are known: NFC, white space and lower case, a split into
letters, digits, other signs and English contractions, byte-level BPE with word ends; and plain byte-level BPE,
whose words keep the space before them. Texts with a special token's name or with characters outside ``_KNOWN``,
and all texts under any other tokenizer, go through the library as a whole. Ids are the same either way; tests hold
the two together. Words are looked up by a 64-bit hash and then compared byte by byte; texts that hold two words of one
hash go through the library as well.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

from ._words import SPACES, polynomial

#: Characters of one piece of work; longer texts are cut at spaces only.
CHUNK = 1 << 21
#: Words remembered at most; beyond, the memory starts again.
REMEMBERED = 1_500_000
#: ASCII and the letters of the Latin blocks: there, every byte of a non-ASCII character is part of a letter.
_KNOWN = regex.compile(r"[\x00-\x7FÀ-ÖØ-öø-ɏ]*+")
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: The split that the array operations carry out.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_KIND = np.full(256, 3, dtype=np.uint8)  # other signs
_KIND[SPACES] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def _split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the pieces of lower-cased UTF-8."""
    kind = np.concatenate(([np.uint8(0)], _KIND[data], [np.uint8(0)]))
    start = (kind[1:-1] != 0) & ((kind[1:-1] != kind[:-2]) | (kind[1:-1] == 2))
    quotes = np.flatnonzero(start & (data == 39) & (kind[2:] == 1))  # a sign of its own before a letter
    if len(quotes):
        near = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = near[quotes + 1], near[quotes + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for q, size in ((quotes[one], 2), (quotes[two], 3)):
            start[q + 1] = False
            after = q + size
            after = after[after < len(data)]
            start[after[kind[after + 1] == 1]] = True
    first = np.flatnonzero(start)
    ends = np.flatnonzero((kind[1:-1] != 0) & (kind[2:] == 0)) + 1
    # a piece ends where the next one starts, or before white space
    nearest = np.minimum(np.append(first[1:], len(data)), ends[np.searchsorted(ends, first, side="right")] if len(ends) else 0)
    return first, nearest


#: Stands between texts; no byte of UTF-8.
_BETWEEN = 255
_BYTE_KIND = _KIND.copy()
_BYTE_KIND[_BETWEEN] = 4


def _split_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the pieces of UTF-8 for plain byte-level BPE.

    Runs of letters, of digits and of other signs, each with one blank before it; contractions; what is left of white
    space. The last sign of white space before a run stands alone unless it is that blank.
    """
    kind = _BYTE_KIND[data]
    before, after = np.concatenate(([np.uint8(4)], kind[:-1])), np.concatenate((kind[1:], [np.uint8(4)]))
    start = kind != before
    last = np.flatnonzero((kind == 0) & (after != 0) & (after != 4))
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    quotes = np.flatnonzero(start & (data == 39) & (after == 1))
    if len(quotes):
        near = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = near[quotes + 1], near[quotes + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for q, size in ((quotes[one], 2), (quotes[two], 3)):
            start[q + 1] = False
            rest = q + size
            rest = rest[rest < len(data)]
            start[rest[kind[rest] == 1]] = True
    start |= kind == 4
    first = np.flatnonzero(start)
    end = np.append(first[1:], len(data))
    word = kind[first] != 4
    return first[word], end[word]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _same(a: np.ndarray, first: np.ndarray, size: np.ndarray, b: np.ndarray, other: np.ndarray) -> bool:
    """Whether the ``size`` bytes from ``first`` in one and from ``other`` in the other are equal for all bounds; both as ``_eights``."""
    while len(first):
        rest = np.minimum(size, 8).astype(np.uint64)
        unused = np.uint64(64) - np.uint64(8) * rest
        if ((a[first] << unused) != (b[other] << unused)).any():
            return False
        more = size > 8
        first, other, size = first[more] + 8, other[more] + 8, size[more] - 8
    return True


class _Words:
    """Words and their ids in a few arrays, by ascending hash."""

    def __init__(self) -> None:
        self.hashes, self.bytes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, "<u4")
        #: Where a word's bytes and ids lie: first of each, number of each.
        self.at = np.zeros((4, 0), np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the hash is there."""
        k = np.searchsorted(self.hashes, hashes)
        there = k < len(self.hashes)
        there[there] = self.hashes[k[there]] == hashes[there]
        return k, there

    def add(self, hashes: np.ndarray, new: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """New words by ascending hash; those of each end in ``ids`` where ``ends`` says."""
        sizes = np.array([len(x) for x in new])
        n = np.diff(ends, prepend=0)
        own = np.array([len(self.bytes) + np.cumsum(sizes) - sizes, len(self.ids) + ends - n, sizes, n])
        k = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at = np.insert(self.hashes, k, hashes), np.insert(self.at, k, own, axis=1)
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(new), np.uint8)))
        self.ids = np.concatenate((self.ids, ids))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        self.words = _Words()
        self.lower, self.plain = self._known(spec), self._known_bytes(spec)
        self.fast = self.lower or self.plain
        if self.fast:
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if self.lower:
            vocabulary, end = self.whole.get_vocab(), spec["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith(end)]] = True
        elif self.plain:  # a sign of the vocabulary stands for a byte
            vocabulary = spec["model"]["vocab"]
            self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.size[list(vocabulary.values())] = [len(w) for w in vocabulary]

    @staticmethod
    def _known(spec: dict) -> bool:
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        first = cuts[0]
        return bool(
            normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
            and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") == _SPLIT
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"]
        )

    @staticmethod
    def _known_bytes(spec: dict) -> bool:
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        return bool(
            spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut["add_prefix_space"]
            and "merges" in model and set(pre_tokenizers.ByteLevel.alphabet()) <= set(model["vocab"]) and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("dropout")
        )

    def _learn(self, hashes: np.ndarray, new: list[bytes]) -> None:
        got = self.model.encode_batch_fast([[x.decode() for x in new]], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(got.ids, dtype="<u4")
        if self.lower:
            ends = np.flatnonzero(self.last[ids]) + 1  # ids of the last part of a word are marked
        else:
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x) for x in new])) + 1
        self.words.add(hashes, new, ids, ends)

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts of known characters, lower-cased if the tokenizer does so."""
        raw = [x.encode() for x in texts]
        joined = (b"\n" if self.lower else bytes([_BETWEEN])).join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        first, end = _split(data) if self.lower else _split_bytes(data)
        if not len(first):
            return [b""] * len(texts)
        hashes, size = polynomial(data, first, end), end - first
        each, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.words.hashes) > REMEMBERED:
            self.words = _Words()
        k, there = self.words.find(each)
        if not there.all():
            unknown = at[~there]
            self._learn(each[~there], [joined[a:z] for a, z in zip(first[unknown].tolist(), end[unknown].tolist(), strict=True)])
            k, _ = self.words.find(each)
        word_at, id_at, word_size, id_size = self.words.at[:, k]
        here, eights = first[at], _eights(data)
        alike = (
            (size[at] == word_size).all() and _same(eights, here, word_size, _eights(self.words.bytes), word_at)
            and (size == word_size[back]).all() and _same(eights, first, size, eights, here[back])
        )
        if not alike:
            return [self._whole(x) for x in texts]
        n = id_size[back]
        ends = np.cumsum(n)
        ids = self.words.ids[np.arange(ends[-1]) + np.repeat(id_at[back] - (ends - n), n)].tobytes()
        bounds = np.cumsum([len(x) + 1 for x in raw])[:-1]
        cut = [0, *(4 * np.append(0, ends)[np.searchsorted(first, bounds)]).tolist(), len(ids)]
        return [ids[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        out: list[bytes] = [b""] * len(texts)
        todo: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (k, _), ids in zip(todo, self._together([x for _, x in todo]) if todo else [], strict=True):
                out[k] += ids
            todo.clear()

        for k, text in enumerate(texts):
            plain = text if self.fast and not any(x in text for x in self.special) else None
            if plain is not None and self.lower:
                plain = unicodedata.normalize("NFC", plain)
                plain = plain.lower() if _KNOWN.fullmatch(plain) else None
            if plain is None or not _KNOWN.fullmatch(plain):
                out[k] = self._whole(text)
                continue
            at = 0
            while at < len(plain):
                # a blank between two signs that aren't white space starts a piece in either split
                cut = _CUT.search(plain, at + CHUNK)
                cut = len(plain) if cut is None else cut.start()
                todo.append((k, plain[at:cut]))
                size, at = size + cut - at, cut
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out
