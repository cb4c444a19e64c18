"""Exact tokenization through a cache of units: stretches of text that a tokenizer never joins across.

A unit's ids don't depend on its surroundings, so a text's ids are its units' ids in a row. Every distinct unit is
encoded by the tokenizers library once per cache; a full cache, and one of a task that ends, keeps only units that were met
repeatedly, which changes no result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import trim

#: Bytes that a worker's cache of units may take, as estimated by Encoder.held, before it is emptied.
CACHE_BYTES = 96 << 20
#: What a unit takes besides its letters and ids: its string, its number and its place in the index.
UNIT_BYTES = 200
#: Units at most that a cache keeps when it is full or its task ends: about 30 MB.
KEPT_UNITS = 120_000
#: Texts handled at a time.
SLICE = 256
#: A byte-level pre-tokenizer starts a new piece at a single space between two other characters, always.
_SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Between a letter and one of these marks both kinds of pre-tokenizers cut, whatever stands around.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|"
#: For texts whose white space is single spaces and newlines between other characters: words, runs of marks, newlines, or
#: else all up to the next of those.
_PLAIN_BYTE = re.compile(rf" ?[{_LETTER}]+(?=[ \n{_MARK}]|\Z)| ?[{_MARK}]+(?=[ \n{_LETTER}]|\Z)|\n| ?[^ \n]+")
_PLAIN_WORD = re.compile(rf"[{_LETTER}]+(?=[ \n{_MARK}]|\Z)|[{_MARK}]+(?=[ \n{_LETTER}]|\Z)|[^ \n]+")


class _Index(dict):
    """Numbers units as they are met; fresh holds those met since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        i = self[unit] = len(self)
        self.fresh.append(unit)
        return i


def split_rule(path: str) -> str:
    """How a tokenizer file allows texts to be cut: before single spaces, at ASCII white space (dropped), or not at all."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return "whole"
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "before_space"
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    parts = (pre or {}).get("pretokenizers") or [{}]
    if set(steps) <= {"NFC", "Replace",
        "Lowercase"} and "Lowercase" in steps and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in parts[0]["pattern"].get("Regex",
        ""):
        return "at_space"
    return "whole"


_ONE_PIECE = {"before_space": re.compile(f" [{_LETTER}]+"), "at_space": re.compile(f"[{_LETTER}]+")}


def _plain(text: str) -> bool:
    """White space is single spaces and newlines between other characters."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ") and text.replace("\n", "").isprintable()


def units_of(text: str | None, rule: str) -> list[str]:
    """A text's units in order; with the rule before_space they make up the text."""
    if not text:
        return []
    if rule == "before_space":
        if _plain(text):
            return _PLAIN_BYTE.findall(text)
        first, *rest = _SPACE_BETWEEN.split(text)
        return [first, *(" " + x for x in rest)]
    if rule == "at_space":
        if text.replace("\n", "").isprintable():
            return _PLAIN_WORD.findall(_lowered(text))
        return [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()]
    return [text]


def _lowered(text: str) -> str:
    """Lower-cases where that surely is what the tokenizer's normalizer does; saves units that differ by case."""
    if "<|" in text:  # a special string is looked for as it stands
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[str, str]:
    """How byte-level tokenizers write the letters of _LETTER above ASCII: a character for each byte."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(c): "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in chr(c).encode()) for c in range(128, 256)}


_ABOVE_ASCII, _BYTE_LETTERS = re.compile(r"[^\x00-\x7f]"), byte_letters()


def words_only(tok, spec: dict, rule: str):
    """A tokenizer of the same model for words of letters, written byte by byte as the model has them, between spaces; None
    where the file's other steps could change such words further than by lower case."""
    pre = spec["pre_tokenizer"]
    byte_level = pre if rule == "before_space" else (pre["pretokenizers"][1:] or [{}])[0]
    plain = byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and bool(byte_level.get("use_regex")) == (rule == "before_space")
    if not plain or len(pre.get("pretokenizers", ())) > 2 or spec["model"]["type"] != "BPE":
        return None
    if any(re.fullmatch(f"[ {_LETTER}]*", t["content"]) for t in spec.get("added_tokens") or []):
        return None
    # White space, the only thing that is replaced, isn't in words, and their letters are their own NFC.
    if any(n["type"] == "Replace" and n["pattern"] != {"Regex": r"\s+"} for n in (spec.get("normalizer") or {}).get("normalizers", [])):
        return None
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(tok.model)
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


class _Ids:
    """Ids of numbered stretches, one after another."""

    def __init__(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.flat, self.starts, self.lens = _room(self.flat, self.used + len(ids)), _room(self.starts, self.n + len(lens)), _room(self.lens, self.n + len(lens))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(lens)] = lens
        self.used += len(ids)
        self.n += len(lens)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these stretches in a row, and where each ends."""
        lens = self.lens[at]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)], ends


class Encoder:
    def __init__(self, path: str) -> None:
        self.tok, self.rule = load(path), split_rule(path)
        self.forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        # Which ids begin or end a piece, by which the ids of many one-piece units can be told apart.
        self.marks = None
        if self.rule == "before_space" or self.rule == "at_space" and suffix:
            vocabulary = self.tok.get_vocab(with_added_tokens=False)
            self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
            self.marks[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.rule == "before_space" else t.endswith(suffix))]] = True
        self.bare = words_only(self.tok, spec, self.rule) if self.marks is not None else None

    def _learn(self) -> None:
        """Ids of the units met for the first time."""
        fresh, self.units.index.fresh = self.units.index.fresh, []
        self.letters += sum(map(len, fresh))
        for k in range(0, len(fresh), 4096):
            self.units.add(*self._encode(fresh[k : k + 4096]))

    def held(self) -> int:
        """About how many bytes the cache takes."""
        return UNIT_BYTES * self.units.n + self.letters + self.units.flat.nbytes

    def forget(self) -> None:
        """Empties the cache; the tokenizer stays."""
        self.units, self.uses, self.end, self.letters = _Ids(), np.zeros(1 << 14, np.int64), None, 0

    def _begin(self, end_id: int | None) -> None:
        self.forget()
        self.end = end_id
        self.units.index[None] = 0  # stands for the end of a text
        self.units.index.fresh.clear()
        self.units.add(np.array([] if end_id is None else [end_id], np.uint32), np.array([int(end_id is not None)]))

    def keep(self) -> None:
        """Drops units met only once since the last time, and the rarest ones above KEPT_UNITS; all if they still take much."""
        old, n = self.units, self.units.n
        if not n:
            return
        uses = _room(self.uses, n)[:n]
        k = 1 + np.flatnonzero(uses[1:] > 1)
        k = np.sort(k[np.argsort(-uses[k], kind="stable")[:KEPT_UNITS]])
        names, (ids, ends) = list(old.index), old.take(k)
        names = [names[i] for i in k.tolist()]
        self._begin(self.end)
        self.units.index.update(zip(names, range(1, len(names) + 1), strict=True))
        self.units.add(ids, np.diff(ends, prepend=0))
        self.letters = sum(map(len, names))
        if self.held() > CACHE_BYTES // 2:
            self.forget()

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and how many each has. Words of letters alone are one piece each, and go in one text."""
        single = np.array([self.marks is not None and _ONE_PIECE[self.rule].fullmatch(u) is not None for u in units], bool)
        lens = np.zeros(len(units), np.int64)
        words = [u for u, yes in zip(units, single.tolist(), strict=True) if yes]
        ids = np.zeros(0, np.uint32)
        if words:
            ids = self._encode_words(words)
            edge = np.flatnonzero(self.marks[ids])
            bounds = np.append(edge, len(ids)) if self.rule == "before_space" else np.concatenate([[0], edge + 1])
            if len(bounds) != len(words) + 1 or bounds[0] != 0 or bounds[-1] != len(ids):
                raise ValueError("the pieces of a text don't agree with its words")
            lens[single] = np.diff(bounds)
        rest = [e.ids for e in self.tok.encode_batch_fast([u for u, yes in zip(units, single.tolist(), strict=True) if not yes], add_special_tokens=False)]
        lens[~single] = np.fromiter(map(len, rest), np.int64, len(rest))
        of_words = np.repeat(single, lens)
        out = np.empty(len(of_words), np.uint32)
        out[of_words] = ids
        out[~of_words] = np.fromiter(chain.from_iterable(rest), np.uint32, len(of_words) - len(ids))
        return out, lens

    def _encode_words(self, words: list[str]) -> np.ndarray:
        """Ids of words of letters, which are one piece each."""
        text = ("" if self.rule == "before_space" else " ").join(words)
        tok = self.bare or self.tok
        if self.bare:  # what the steps before the model make of words
            if self.rule == "at_space":
                text = text.lower()
            if not text.isascii():
                text = _ABOVE_ASCII.sub(lambda m: _BYTE_LETTERS[m[0]], text)
            if self.rule == "before_space":
                text = text.replace(" ", " \u0120")
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (null: none), with end_id after each text, and where each text starts, with the end."""
        if self.held() > CACHE_BYTES:
            self.keep()
        if end_id != self.end or not self.units.n:
            self._begin(end_id)
        units, n_units = [], [0]
        for t in texts:
            units += units_of(t, self.rule)
            n_units.append(len(units))
        at = np.fromiter(map(self.units.index.__getitem__, units), np.int64, len(units))
        self._learn()
        self.uses = _room(self.uses, self.units.n)
        self.uses[: self.units.n] += np.bincount(at, minlength=self.units.n)
        n_units = np.array(n_units)
        ids, ends = self.units.take(np.insert(at, n_units[1:], 0))
        return ids, np.concatenate([[0], ends])[n_units + np.arange(len(n_units))]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file. Its tokenizer outlives tasks where Spark keeps workers; of its cache only a part may, see kept()."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def kept(rows: Iterator) -> Iterator:
    """rows of a task that uses encoder(); when they end, the cache keeps frequent units, and other memory is given back."""
    try:
        yield from rows
    finally:
        for e in _ENCODERS.values():
            e.keep()
        trim()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))


def slices(batches: Iterator, n: int = SLICE) -> Iterator:
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
