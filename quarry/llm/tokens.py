"""Token ids of whole texts through the tokenizers library, word by word.

The vocabularies known here join nothing across a space or line feed between words, so a
text's ids are the ids of its words in a row, and each distinct word goes through the
library once for as long as it is remembered. A plain word is letters and then ASCII marks;
both are pieces that no pattern of the vocabulary cuts, and go to the library many at a
time with a separator between them that is a token of its own. Other words go as they
stand. What none of that holds for, the strings of special tokens among it, is encoded as a
whole text, and so is every text of a vocabulary of another make: see `Encoder`. Ids are
always those of an unaltered tokenizer without added special tokens.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a task remembers, about 250 bytes each; beyond it the most used half of those used again stays.
MEMORY = 400_000
#: Words that stay remembered between tasks.
KEPT_WORDS = 40_000
#: Texts, and characters of texts, that are looked up at once; a longer text goes in parts.
TEXTS, CHARACTERS = 1000, 4_000_000

#: Letters below U+0250 whose lower case is one letter too.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha())
_MARKS = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"))
#: Printable bytes stand for themselves in byte-level vocabularies, the others for characters from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARACTERS = "".join(chr(b) if b in _PRINTED else chr(256 + _HIDDEN.index(b)) for b in range(256))
#: The line feed, as it stands in byte-level vocabularies.
_MARK = _BYTE_CHARACTERS[10]
#: A space with words on both sides of it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _make(described: dict) -> str | None:
    """spaced: a word takes the space before it into its first token; ended: white space vanishes; else None."""
    model, added = described["model"], described["added_tokens"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("unk_token") or described["truncation"] or described["padding"]:
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
        return None
    shape = json.dumps({k: described[k] for k in ("normalizer", "pre_tokenizer")}, sort_keys=True)
    for name, normalizer, pre in (("spaced", *_SPACED), ("ended", *_ENDED)):
        if shape == json.dumps({"normalizer": normalizer, "pre_tokenizer": pre}, sort_keys=True):
            return name
    return None


# The normalizers and pre-tokenizers that the rules above hold for.
_SPACED = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_ENDED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class _Places(dict):
    """Numbers of words in the order of their first use; new ones also stand in a list."""

    def __init__(self, words: list[str] = []):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


def _rows(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run in a row."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + count, count)


class Encoder:
    """ids(texts) of a tokenizer file.

    A text that holds a special token's string, and with spaced words one with an empty word
    or a word that begins or ends in white space, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in described["added_tokens"]]
        self.make = _make(described)
        if self.make:
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = Sequence([])
            self.pieces.pre_tokenizer = Split(_MARK, "isolated")
            mark = self._batch(self.pieces, [_MARK])[0]
            if len(mark) != 1:
                self.make = None
            else:
                self.mark = mark[0]
        self.spaced = self.make == "spaced"
        # a line feed before it; letters and marks of a plain word, or all of another
        self.plain = re.compile(rf"(\n?)(?:([{_LETTERS}]+|[0-9]+)([{_MARKS}]*)(?= ))?([^ ]*) " if self.spaced else rf"()(?:([{_LETTERS}]+)([{_MARKS}]*)(?= ))?([^ ]*) ")
        self._clear()

    def _clear(self) -> None:
        self.places = _Places()
        self.flat = np.empty(0, np.uint32)
        self.start, self.count, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def forget(self, most: int = KEPT_WORDS) -> None:
        """Remember the most used of the words that were used again, at most so many."""
        self._learn()
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-self.used[keep], most)[:most]])
        words = list(self.places)
        self.places = _Places([words[k] for k in keep.tolist()])
        self.start, self.count, self.used = self.start[keep], self.count[keep], self.used[keep]
        own = np.maximum(self.count, 0)
        self.flat = self.flat[_rows(self.start, own)]
        self.start = np.cumsum(own) - own

    @staticmethod
    def _batch(tokenizer, texts: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), 4096):
            out += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        return out

    def _learn(self) -> None:
        """Ids of the new words; a count of -1 marks a word whose text has to be encoded whole."""
        words, self.places.new = self.places.new, []
        if not words:
            return
        stems: dict[str, int] = {}
        number, one_space, spaced = stems.setdefault, " " if self.spaced else "", self.spaced
        line_, stem_, rest_, odd, alone = [], [], [], [], []
        for k, (opens, own, marks, other) in enumerate(self.plain.findall(" ".join(words) + " ")):
            if own:
                line_.append(1 if opens else 0)
                if not spaced:
                    own = own.lower()
                elif not opens:
                    own = one_space + own
                stem_.append(number(own, len(stems)))
                rest_.append(number(marks, len(stems)) if marks else -1)
                continue
            stem_.append(-1)
            rest_.append(-1)
            if not spaced:
                line_.append(0)
                odd.append(k)
                alone.append(other)
            elif opens and not other:
                line_.append(1)
            elif not other or other[0].isspace() or other[-1].isspace():
                line_.append(-1)
            else:
                line_.append(0)
                odd.append(k)
                alone.append((opens or " ") + other)
        line, stem, rest = (np.array(x, np.int64) for x in (line_, stem_, rest_))
        assert len(line) == len(words), "a word holds no space"
        pieces, counts = self._each(list(stems))
        first = np.cumsum(counts) - counts
        # the ids of a word: a line feed, its letters, its marks
        n = [np.maximum(line, 0), np.where(stem >= 0, counts[stem], 0) if len(counts) else np.zeros(len(words), np.int64), np.where(rest >= 0, counts[rest], 0) if len(counts) else np.zeros(len(words), np.int64)]
        total = n[0] + n[1] + n[2]
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]), np.uint32)
        out[(ends - total)[n[0] > 0]] = self.mark
        for at, size, source in ((ends - n[2] - n[1], n[1], stem), (ends - n[2], n[2], rest)):
            some = size > 0
            out[_rows(at[some], size[some])] = pieces[_rows(first[source[some]], size[some])]
        start, count = len(self.flat) + ends - total, np.where(line < 0, -1, total)
        parts, used = [self.flat, out], len(self.flat) + len(out)
        for k, ids in zip(odd, self._batch(self.tokenizer, alone)):
            start[k], count[k] = used, len(ids)
            parts.append(ids)
            used += len(ids)
        self.flat = np.concatenate(parts)
        self.start, self.count = np.concatenate((self.start, start)), np.concatenate((self.count, count))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and the count of each; 64 go through the library as one text."""
        flat, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        groups = ["\n".join(pieces[k : k + 64]) for k in range(0, len(pieces), 64)]
        for k in range(0, len(groups), 1024):
            some = [codecs.charmap_decode(g.encode(), "strict", _BYTE_CHARACTERS)[0] for g in groups[k : k + 1024]]
            for ids in self._batch(self.pieces, some):
                marks = ids == self.mark
                cuts = np.flatnonzero(marks)
                flat.append(ids[~marks])
                counts.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
        out = np.concatenate(counts)
        assert len(out) == len(pieces), "the separator is a token of its own"
        return np.concatenate(flat), out

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text in turn; a null text is empty."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > CHARACTERS or size + len(text) > CHARACTERS or len(held) == TEXTS:
                yield from self._ids(held)
                held, size = [], 0
            if len(text) > CHARACTERS:
                yield self._long(text)
            else:
                held.append(text)
                size += len(text)
        yield from self._ids(held)

    def _whole(self, text: str) -> np.ndarray:
        return self._batch(self.tokenizer, [text])[0]

    def _long(self, text: str) -> np.ndarray:
        """The ids of a text that is looked up in parts, cut at spaces between words."""
        at, out = 0, []
        while at < len(text):
            m = _CUT.search(text, at + CHARACTERS)
            part = self._ids([text[at : m.start() if m else len(text)]], opening=not at, whole=False)[0]
            if part is None:
                return self._whole(text)
            out.append(part)
            at = m.end() if m else len(text)
        return np.concatenate(out)

    def _ids(self, texts: list[str], opening: bool = True, whole: bool = True) -> list[np.ndarray | None]:
        """The ids of each text; opening: whether they begin a text. What has to be encoded whole is None where whole is False."""
        if len(self.places) > MEMORY:
            self.forget(MEMORY // 2)
        lines: list[str | None] = []
        for text in texts:
            if not text or not self.make or any(s in text for s in self.special):
                lines.append(None)
            elif self.spaced:  # the start of a text is as the start of a line, but for the line feed
                lines.append(("\n" if opening else "") + text.replace("\n", " \n"))
            else:
                lines.append(text.replace("\n", " "))
        lists = pc.split_pattern(pa.array(lines, pa.string()), " ")
        words = lists.flatten().dictionary_encode()
        own = np.fromiter(map(self.places.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        self._learn()
        at = own[words.indices.to_numpy(zero_copy_only=False)]
        self.used += np.bincount(at, minlength=len(self.used))
        start, count = self.start[at], self.count[at]
        bad = count < 0
        if self.spaced and "\n" in self.places:
            # two empty lines in a row are one token
            empty = at == self.places["\n"]
            bad[1:] |= empty[1:] & empty[:-1]
        count = np.maximum(count, 0)
        flat = self.flat[_rows(start, count)]
        words_to = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
        ids_to = np.concatenate(([0], np.cumsum(count)))
        out: list[np.ndarray | None] = []
        for text, a, b in zip(texts, [0, *words_to[:-1]], words_to):
            if a == b and text or bad[a:b].any():
                out.append(self._whole(text) if whole else None)
            else:
                out.append(flat[int(ids_to[a]) + (self.spaced and opening and b > a) : int(ids_to[b])])
        return out


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process, with what it remembers."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]
