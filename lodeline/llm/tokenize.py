"""Whole texts to token ids, with each different piece of text encoded once.

Words come back again and again, so a worker keeps the ids of the pieces it has
seen. A text is cut before a space or line feed that stands alone between two
characters that are no white space. The pre-tokenizers in use split there in any
case and look at nothing beyond, so the ids of the pieces, joined, are those of
the whole text. Nothing is cut at runs of white space or at other white space. A
piece that is one word with ASCII marks behind it is cut once more, between the
word and the marks, where the same holds.
"""

from __future__ import annotations

import json
import re

import numpy as np

from lodeline.llm.common import quiet_tokenizers

# Python splits at these, and the library does not take them for white space.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# White space, a word, and marks other than the apostrophe, which opens endings.
_WORD_AND_MARKS = re.compile(r"([ \n]?)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
# A worker starts its caches anew beyond these, which bounds its memory.
CACHE_PIECES = 500_000
CACHE_CHARS = 16_000_000
# White space of this length, of whatever kinds, is a long run.
LONG_RUN = 50_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class PieceCache(dict):
    """Number of a piece; a piece not seen before gets the next one.

    A string is a piece found by splitting at every space; it is -1 where such a
    split must not stand. A tuple holds a piece found by the exact pattern.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.known = 0
        self.chars = 0

    def __missing__(self, key: str | tuple[str]) -> int:
        piece = key
        if isinstance(key, tuple):
            piece = key[0]
        elif not key or key[-1].isspace() or (key[0] in " \n" and key[1].isspace()):
            self[key] = -1
            return -1
        place = self[key] = self.known
        self.known += 1
        self.chars += len(piece)
        self.new.append(piece)
        return place


class Spelling(dict):
    """Characters as the byte-level step of the library spells them."""

    def __missing__(self, code: int) -> str:
        from tokenizers import pre_tokenizers

        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = self[code] = "".join(part for part, _ in step.pre_tokenize_str(chr(code)))
        return spelled


class Library:
    """The tokenizers library with one file.

    It finds added tokens in a text before anything else, so a text that may hold
    one is encoded by the library itself. ``marks`` are the beginnings of their
    names up to the first letter, which no normal form changes.
    """

    def __init__(self, path: str) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {re.match(r"[^\w\s]*", name)[0] for name in names}

    def may_hold_added(self, text: str) -> bool:
        return any(mark in text for mark in self.marks)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class TextEncoder:
    """Ids of texts by the file of a byte-level tokenizer of the tokenizers library.

    A file for which space is no token must drop the case of letters as well.
    """

    def __init__(self, path: str) -> None:
        self.library = Library(path)
        self.tokenizer = self.library.tokenizer
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.letters_keep, self.lowers = _letters_keep(path)
        self.spelling = Spelling()
        self.space_counts = bool(self._whole([" "])[0]) or self._whole(["A"]) != self._whole(["a"])
        self._start_over()

    def _start_over(self) -> None:
        self.pieces = PieceCache()
        self.words: dict[str, list[int]] = {}
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32; an empty text has none."""
        if self.pieces.known > CACHE_PIECES or self.pieces.chars > CACHE_CHARS:
            self._start_over()
        whole = {i: self.library.ids(text) for i, text in enumerate(batch) if self.library.may_hold_added(text)}
        places = [self._places(text) if text and i not in whole else None for i, text in enumerate(batch)]
        self._learn()
        return [whole.get(i, np.empty(0, np.uint32)) if p is None else self._join(p) for i, p in enumerate(places)]

    def _places(self, text: str) -> np.ndarray:
        look = self.pieces.__getitem__
        if not self.space_counts and not any(c in text for c in _NO_SPACE):
            # Space only separates; case is dropped too, so pieces need not differ by ASCII case.
            cuts = text.encode().lower().decode().split()
            return np.fromiter(map(look, cuts), np.int64, len(cuts))
        parts = text.replace("\n", " \n").split(" ")
        cuts = [p if p[:1] == "\n" else " " + p for p in parts]
        cuts[0] = parts[0]
        places = np.fromiter(map(look, cuts), np.int64, len(cuts))
        if places.min() < 0:
            cuts = [(piece,) for piece in _CUT.split(text)]
            places = np.fromiter(map(look, cuts), np.int64, len(cuts))
        return places

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str) -> list[int] | None:
        """Ids of one word or run of marks; None where its normal form is more than that."""
        found = self.words.get(word)
        if found is None:
            if self.letters_keep and word.isascii() and word.isalpha():
                spelled = word.lower() if self.lowers else word
            else:
                spelled = word
                if self.normalizer is not None:
                    spelled = self.normalizer.normalize_str(word)
                    if not spelled.isascii() and not spelled.isalpha():
                        return None
                spelled = spelled.translate(self.spelling)
            found = self.words[word] = [t.id for t in self.model.tokenize(spelled)]
        return found

    def _parts(self, piece: str) -> list[int] | None:
        match = _WORD_AND_MARKS.fullmatch(piece)
        if not match or not match[2].isalpha():
            return None
        space, word, marks = match.groups()
        ahead: list[int] = []
        if self.space_counts and space == " ":
            word = " " + word
        elif self.space_counts and space:
            ahead = self._word(space)
        core = self._word(word)
        if core is None:
            return None
        return ahead + core + self._word(marks) if marks else ahead + core

    def _learn(self) -> None:
        new = self.pieces.new
        if not new:
            return
        found = [self._parts(piece) for piece in new]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self._whole([new[i] for i in rest])):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.pieces.new = []

    def _join(self, places: np.ndarray) -> np.ndarray:
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))]


def _letters_keep(path: str) -> tuple[bool, bool]:
    """Whether a file's normal form changes nothing about ASCII letters but their case, and whether it drops that."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    harmless = lambda s: s["type"] in ("NFC", "NFKC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"})
    return all(map(harmless, steps)), any(s["type"] == "Lowercase" for s in steps)


class RankEncoder:
    """Ids of texts by a byte-level file whose ids are in the order of its merges.

    Such a file says the same as a table of ranks, which encodes whole texts
    several times faster; a file of another kind is refused. A run of white space
    makes its pattern search one level deeper per character, so a text with a very
    long run is encoded by the library itself, which gives the same ids.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        step, model = whole["pre_tokenizer"], whole["model"]
        if whole["normalizer"] or step["type"] != "ByteLevel" or not step["use_regex"] or step["add_prefix_space"]:
            raise ValueError("the file does more than byte-level splitting")
        self.library = Library(path)
        special = {t["content"] for t in whole["added_tokens"]}
        vocab = {token: i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(merges)
        if any(vocab[a + b] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids are not in the order of the merges")
        spelled = _byte_spelling()
        ranks = {bytes(spelled[c] for c in token): i for token, i in vocab.items()}
        self.vocabulary = len(model["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]})
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32; an empty text has none."""
        return [
            self.library.ids(text) if self.library.may_hold_added(text) or self._has_long_run(text)
            else np.asarray(self.encoding.encode_ordinary(text), np.uint32)
            for text in batch
        ]

    @staticmethod
    def _has_long_run(text: str) -> bool:
        return len(text) >= LONG_RUN and _LONG_SPACE.search(text) is not None


def _byte_spelling() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, all other bytes in
    ascending order for the characters from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[str, TextEncoder | RankEncoder] = {}


def encoder(path: str) -> TextEncoder | RankEncoder:
    """The encoder of a worker, which lives as long as the worker does."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        try:
            _ENCODERS[path] = RankEncoder(path)
        except ValueError:
            _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
