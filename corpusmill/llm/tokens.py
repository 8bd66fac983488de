"""Token ids of whole Arrow columns of texts, equal to encoding each text by itself.

The `tokenizers` library spends most of its time on words it has met before. Both kinds of tokenizer
known here never join characters across a single space, so texts are cut at spaces, each different
piece of a slice is encoded once, and the ids are put together by Arrow. Pieces of plain letters,
digits and punctuation are cut, all of a slice at once, as the tokenizer's own pattern cuts them, and
their words go to its model directly, each once while a worker remembers it; any other piece goes
through ``encode``; so does a whole text of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Letters whose lower case and composition are the same in every Unicode version.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = rf"\A ?[{_L}0-9!-/:-@\[-`{{-~\n]+\z"
_SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Between pieces; no plain piece holds it.
_GAP = "\0"
#: Spaces stay in front of words.
_KEPT = re.compile(rf"{_GAP}|{_SHORT_FORMS}| ?[{_L}]+| ?[0-9]+| ?[^ \n{_GAP}{_L}0-9]+|\n+(?![^\n{_GAP}])|\n+| ")
#: White space goes.
_DROPPED = re.compile(rf"{_GAP}|{_SHORT_FORMS}|[{_L}]+|[0-9]|[^ \n{_GAP}{_L}0-9]+")
_WHITE = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space next to more white space: such texts are encoded whole where spaces are kept.
_ODD_SPACE = f"{_WHITE} | {_WHITE}"
#: Remembered words of a worker, after which it begins anew.
_REMEMBERED = 400_000
_SLICE_BYTES = 8 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it is visible, the others in order from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = self._kind(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(special)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _kind(made: dict) -> str:
        before = made.get("pre_tokenizer") or {}
        plain_model = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not made["model"].get("ignore_merges")
        if not plain_model or made.get("post_processor") not in (None, {}) and made["post_processor"].get("type") != "ByteLevel":
            return "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not made.get("normalizer"):
            return "kept"
        steps = [s.get("type") for s in before.get("pretokenizers", [])]
        forms = [s.get("type") for s in (made.get("normalizer") or {}).get("normalizers", [])]
        pattern = next((s["pattern"].get("Regex") for s in before.get("pretokenizers", []) if s.get("type") == "Split"), None)
        known = _SHORT_FORMS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return "dropped" if steps == ["Split", "ByteLevel"] and forms == ["NFC", "Replace", "Lowercase"] and pattern == known else "whole"

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalnum():
            written = word
        elif word[0] == " " and word.isascii() and word[1:].isalnum():
            written = self.letters[0x20] + word[1:]
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        if len(self.words) >= _REMEMBERED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces on end, the number of ids of each, and for each piece its place among them."""
        strings = pa.array(pieces, pa.string())
        plain = pc.match_substring_regex(strings, _PLAIN)
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(strings, self.special))
        plain = plain.to_numpy(zero_copy_only=False)
        joined = _GAP.join([p for p, ok in zip(pieces, plain.tolist()) if ok] + [""])
        words = _KEPT.findall(joined) if self.kind == "kept" else _DROPPED.findall(joined.lower())
        known, make = self.words.get, self._word
        table = [b"" if w == _GAP else known(w) or make(w) for w in words]
        # Bytes, unlike tuples, are nothing for the garbage collector to walk through.
        upto = np.cumsum(np.fromiter(map(len, table), np.int64, len(table))) // 4
        ends = upto[np.fromiter(map(_GAP.__eq__, words), bool, len(words))]
        odd = [self._whole(pieces[i]) for i in np.flatnonzero(~plain).tolist()]
        values = np.frombuffer(b"".join(table + odd), "<u4")
        lengths = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, odd), np.int64, len(odd)) // 4])
        place = np.empty(len(pieces), np.int64)
        place[np.argsort(~plain, kind="stable")] = np.arange(len(pieces))
        return values, lengths, place

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _slice(self, texts: pa.Array, only_count: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if self.kind == "whole":
            alone = np.arange(n)
        elif self.kind == "kept":
            alone = np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False))
        else:
            alone = np.array([], int)
        apart = texts
        if len(alone):  # their pieces are left out, their ids put in below
            mask = np.zeros(n, bool)
            mask[alone] = True
            apart = pc.if_else(pa.array(mask), "", texts)
        lists = pc.split_pattern(apart, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "kept":
            # All pieces but a text's first have a space in front.
            firsts = bounds[:-1][np.diff(bounds) > 0]
            opening = [pieces[i] for i in which[firsts]]
            which[firsts] = np.arange(len(pieces), len(pieces) + len(firsts))
            pieces = [" " + p for p in pieces] + opening
        values, lengths, place = self._ids(pieces)
        which = place[which]
        if len(alone):
            which[bounds[:-1][alone]] = np.arange(len(pieces), len(pieces) + len(alone))
            own = [self._whole(t) for t in texts.take(pa.array(alone)).to_pylist()]
            values = np.concatenate([values, np.frombuffer(b"".join(own), "<u4")])
            lengths = np.concatenate([lengths, np.fromiter(map(len, own), np.int64, len(own)) // 4])
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths[which])])[bounds])
        if only_count:
            return np.zeros(0, "<u4"), counts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)).take(pa.array(which))
        return ids.flatten().to_numpy(), counts

    def encode(self, texts: pa.Array, only_count: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts on end, and the number of ids of each; null is the empty text."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ids, counts, start, held = [], [], 0, 0
        for i in range(len(sizes) + 1):
            if i == len(sizes) or held and held + sizes[i] > _SLICE_BYTES:
                if i > start:
                    a, b = self._slice(texts.slice(start, i - start), only_count)
                    ids.append(a)
                    counts.append(b)
                start, held = i, 0
            if i < len(sizes):
                held += int(sizes[i])
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        return self.encode(texts, only_count=True)[1]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder of a file in each worker."""
    return TextEncoder(path)
