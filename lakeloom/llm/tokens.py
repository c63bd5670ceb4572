"""Token ids of whole texts by the tokenizers library, once for each distinct piece.

A text whose spaces each stand between two characters that are not white space can be cut before
every space without changing a pre-token, so its ids are those of its pieces, one after the other.
Pieces repeat: each batch gives its distinct pieces to the library, and each worker keeps the ids of up
to ``KEPT`` pieces that it has seen.  Texts that cannot be cut like this go to the library as they are.

The library keeps some hundred bytes for each token while it encodes, so it gets about ``GROUP``
characters at a time, and a longer text in parts.  A part ends before a single space between two ASCII
letters: both kinds of vocabulary file start a new pre-token there, whatever stands around, and neither
lower case nor composition of characters reaches across it.

Vocabularies of lower-case words know no white space, so ``WordEncoder`` cuts every text, into words.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 200_000
WORDS = 500_000  # as many words are kept instead, each some 170 bytes
GROUP = 1 << 18
#: White space other than space and newline, and the places where a cut before a space could change a pre-token.
_UNCUTTABLE = "^ | $| [ \n]|\n |[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_PLAIN = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_SPACE = "Ġ"  # how byte-level vocabularies write a space
_PLACE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_encoders: dict[str, Encoder] = {}
#: What a file of lower-case words says about white space and words, if ``WordEncoder`` may read it.
_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[" + re.escape(_MARKS) + "]*$"
LONG = 64  # longer pieces are not kept


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def parts_of(text: str, size: int = GROUP) -> list[str]:
    """The text in parts of about ``size`` characters that can be encoded one by one."""
    parts, at = [], 0
    while len(text) - at > 2 * size and (place := _PLACE.search(text, at + size)):
        parts.append(text[at : place.start()])
        at = place.start()
    parts.append(text[at:])
    return parts


class CachedPieces:
    """Encodes whole texts by their distinct pieces; ``library`` and ``pieces`` say how."""

    def __init__(self):
        self.kept: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: one space, or none at the start of a text, and what follows up to the next space."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text; none for null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        out: list = [None] * len(texts)
        whole = np.asarray(pc.match_substring_regex(texts, _UNCUTTABLE))
        for at, ids in zip(np.flatnonzero(whole), self.library(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            out[at] = np.frombuffer(ids, dtype="<u4")
        cut = np.flatnonzero(~whole)
        if not len(cut):
            return out
        lists = pc.split_pattern(texts.take(pa.array(cut)), " ")
        flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes, words = np.array(coded.indices), coded.dictionary.to_pylist()
        known = self.kept
        held = list(map(known.get, words))
        missing = [at for at, ids in enumerate(held) if ids is None]
        room = KEPT - len(known)
        for at, ids in zip(missing, self.pieces([" " + words[at] for at in missing]), strict=True):
            held[at] = ids
            if room > 0:
                known[words[at]] = ids
                room -= 1
        # no space stands before a text's first piece
        firsts = offsets[:-1]
        held += self.pieces([words[c] for c in codes[firsts]])
        codes[firsts] = len(words) + np.arange(len(firsts))
        pool = np.frombuffer(b"".join(held), dtype="<u4")
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[offsets]
        for n, at in enumerate(cut):
            out[at] = ids[bounds[n] : bounds[n + 1]]
        return out


class Encoder(CachedPieces):
    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            self.word_end = json.load(file)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.marks[[n for token, n in vocabulary.items() if (token.endswith(self.word_end) if self.word_end else token.startswith(_SPACE))]] = True

    def pieces(self, pieces: list[str]) -> list[bytes]:
        joined = np.asarray(pc.match_substring_regex(pa.array(pieces, pa.large_string()), _PLAIN))
        out: list = [None] * len(pieces)
        for ids, at in ((self._joined, np.flatnonzero(joined)), (self._ids, np.flatnonzero(~joined))):
            for group in np.split(at, np.flatnonzero(np.diff(np.cumsum([len(pieces[n]) for n in at]) // GROUP)) + 1):
                for n, found in zip(group, ids([pieces[n] for n in group]), strict=True):
                    out[n] = found
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Pieces as one text, which saves the cost of a call; ids are dealt out by the marks of their tokens."""
        if not pieces:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        marked = np.flatnonzero(self.marks[ids])
        if self.word_end:  # letters are one word, and so is a mark of punctuation behind them
            last = np.cumsum([1 + (p[-1] in ".,") for p in pieces]) - 1
            bounds = [0, *(4 * (marked[last] + 1)).tolist()]
        else:  # only the first token of a piece starts with a space
            bounds = [*(4 * marked).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def library(self, texts: list[str]) -> list[bytes]:
        parts = [parts_of(text) for text in texts]
        group, ids, size = [], [], 0
        for part in (part for own in parts for part in own):
            group.append(part)
            size += len(part)
            if size >= GROUP:
                ids += self._ids(group)
                group, size = [], 0
        ids = iter(ids + self._ids(group))
        return [b"".join(next(ids) for _ in own) for own in parts]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, dtype="<u4").tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands at these places of the pool, one after the other, and where each ends."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordEncoder(Encoder):
    """For vocabularies of lower-case words: no token reaches across white space, so any text is cut at spaces and newlines.

    Letters and punctuation behind them never share a token either.  A piece of Latin letters and ASCII
    punctuation has the ids of its word in lower case, and then those of the punctuation, so far fewer
    different texts go to the library.  Other pieces go there as they are.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.bare = Tokenizer.from_file(path)  # for words in lower case, on which the file's normalizers and pattern do nothing
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.behind: dict[str, bytes] = {"": b""}

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        added = [t["content"] for t in found.get("added_tokens") or [] if not t["special"]]
        return bool(found["model"].get("end_of_word_suffix")) and not added and all(found.get(part) == want for part, want in _WORDS.items())

    def _of(self, texts: pa.Array, known: dict[str, bytes], most: int, encode) -> list[bytes]:
        """Ids of different texts, from those that are known or by ``encode``; up to ``most`` are kept."""
        names = texts.to_numpy(zero_copy_only=False).tolist()
        held = list(map(known.get, names))
        missing = [at for at, ids in enumerate(held) if ids is None]
        lengths = np.cumsum([len(names[at]) for at in missing])
        for group in np.split(np.array(missing, dtype=np.int64), np.flatnonzero(np.diff(lengths // GROUP)) + 1):
            asked = [names[at] for at in group]
            for at, name, ids in zip(group.tolist(), asked, encode(asked), strict=True):
                held[at] = ids
                if len(known) < most and len(name) <= LONG:
                    known[name] = ids
        return held

    def _words(self, words: list[str]) -> list[bytes]:
        """Words as one text, which saves the cost of a call; the last token of each is marked."""
        if not words:
            return []
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        bounds = [0, *(4 * (np.flatnonzero(self.marks[ids]) + 1)).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        coded = flat.dictionary_encode()
        codes, pieces = np.asarray(coded.indices), coded.dictionary
        plain = pc.match_substring_regex(pieces, _WORD)
        lower = pc.utf8_lower(pieces.filter(plain))
        words = pc.utf8_rtrim(lower, _MARKS).dictionary_encode()
        behind = pc.utf8_ltrim(lower, _LETTERS).dictionary_encode()
        held = self._of(words.dictionary, self.words, WORDS, self._words)
        held += self._of(pieces.filter(pc.invert(plain)), self.kept, KEPT, self._ids)
        first_behind = len(held)
        held += self._of(behind.dictionary, self.behind, KEPT, self._ids)
        held.append(b"")
        # each piece is a word and what stands behind it, or one text and nothing
        plain = np.asarray(plain)
        parts = np.full((len(pieces), 2), len(held) - 1)
        parts[plain, 0] = np.asarray(words.indices)
        parts[plain, 1] = np.asarray(behind.indices) + first_behind
        parts[~plain, 0] = len(words.dictionary) + np.arange(np.count_nonzero(~plain))
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        starts = np.cumsum(lengths) - lengths
        pool, ends = _gather(np.frombuffer(b"".join(held), dtype="<u4"), starts[parts.ravel()], lengths[parts.ravel()])
        ends = ends[1::2]
        starts = np.append(0, ends[:-1])
        ids, ends = _gather(pool, starts[codes], (ends - starts)[codes])
        bounds = np.append(0, ends)[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if WordEncoder.fits(path) else Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; the folder can be set by LAKELOOM_TOKENIZERS."""
    if folder := os.environ.get("LAKELOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
