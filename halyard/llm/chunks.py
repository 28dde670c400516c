"""Exact token ids of whole texts at the cost of their distinct chunks.

A text is cut where the tokenizer's own pre-tokenization provably cuts as well, so that its ids are its chunks' ids one
after another. Every chunk is encoded by the tokenizers library, once while it stays cached. Texts that such cuts may
not hold for, and tokenizers of another make, go through the library whole.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
import threading
import types
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: What a cut at blanks and newlines may not hold for: other white space, the mark used for cutting, most runs.
_OTHER = re.compile(r"[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", " \n", "\n ", "\n\n\n")
#: Chunks of letters, digits and marks that any Unicode version sorts alike and NFC leaves alone, and their
#: pre-tokens, by kind: fixed values of the two tokenizers' patterns for these characters.
_SIMPLE = re.compile(r" ?[!-~À-ÖØ-öø-ÿ]+")
_CUT = {
    "blanks": r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+| ",
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+",
}
#: Seconds after which an idle worker drops its encoders; distinct chunks kept in each of two generations; characters
#: cut at a time.
IDLE_S = 2.0
GENERATION, SLICE = 500_000, 1_000_000


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    def __init__(self, path: str, generation: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind_of(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        special = [t for t in spec.get("added_tokens", []) if t.get("special") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        if len(special) != len(spec.get("added_tokens", [])):
            self.kind = "whole"
        self.marks = [t["content"] for t in special]
        self.runs = _RUNS + tuple("\n\n" + m[0] for m in self.marks)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.latin = str.maketrans({chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(256)})
        self.tokenize = self.model.tokenize
        self.cut, self.short = re.compile(_CUT[self.kind]) if self.kind in _CUT else None, {}
        self.new, self.generation = Known(self._ids), generation or GENERATION

    def chunks(self, text: str) -> list[str] | None:
        """The text's chunks, or None where it must stay whole."""
        if self.kind == "words":
            return text.replace("\n", " ").split(" ")
        if self.kind == "blanks" and self.regular(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return None

    def regular(self, text: str) -> bool:
        return not (_OTHER.search(text) or text.endswith("\n\n") or any(r in text for r in self.runs))

    def _ids(self, word: str) -> bytes:
        """A chunk's ids: of words, marks and numbers by the library's model, of others by all of its steps."""
        body = word[1:] if word[0] == " " else word
        if self.cut and body.isalpha() and (body.isascii() or max(body) <= "ÿ"):
            return self._model(word)
        if self.cut and body[:-1].isalpha() and body[-1] in ".," and (body.isascii() or max(body) <= "ÿ"):
            return self._model(word[:-1]) + self._part(body[-1])
        if not self.cut or not _SIMPLE.fullmatch(word) or any(m[0] in word for m in self.marks):
            return self._library([word])[0]
        return b"".join(map(self._part, self.cut.findall(word.lower() if self.kind == "words" else word)))

    def _part(self, part: str) -> bytes:
        """Marks and numbers recur; words mostly do not."""
        if part[-1].isalpha():
            return self._model(part)
        if part not in self.short:
            if len(self.short) > 20_000:
                self.short.clear()
            self.short[part] = self._model(part)
        return self.short[part]

    def _model(self, part: str) -> bytes:
        """Ids of one pre-token, whose letters are at most U+00FF."""
        if self.kind == "words":
            part = part.lower()
        part = part.replace(" ", "Ġ") if part.isascii() else part.translate(self.latin)
        return array(self.code, [t.id for t in self.tokenize(part)]).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, chunks: list[str]) -> Iterator[bytes]:
        """Each chunk's ids."""
        if len(self.new) > self.generation:
            self.new = Known(self._ids, self.new)
        return map(self.new.__getitem__, chunks)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian numbers of ``dtype``."""
        for text in texts:
            own = self.chunks(text)
            yield self._library([text])[0] if own is None else b"".join(self.ids(own))


class Known(dict):
    """Chunks' ids, found once; what the generation before knew is taken over."""

    def __init__(self, find, before=None, empty=b""):
        self.find, self.before = find, before or {}
        super().__init__({"": empty})
        if before:
            before.before = {}

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = dict.get(self.before, word) or self.find(word)
        return ids


def simple(coder: ChunkEncoder, chunk: str) -> list[str] | None:
    """The pre-tokens of a chunk of letters, digits and marks that any Unicode version sorts alike; None for others."""
    if not coder.cut or not _SIMPLE.fullmatch(chunk) or any(m[0] in chunk for m in coder.marks):
        return None
    return coder.cut.findall(chunk)


def kind_of(spec: dict) -> str:
    """How texts for this tokenizer may be cut: "blanks" keep the blank before a word, "words" drop white space."""
    before, form = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("truncation") or spec.get("padding"):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and form is None:
        return "blanks"
    steps, forms = before.get("pretokenizers") or [{}], (form or {}).get("normalizers", [])
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    plain = [f["type"] for f in forms] == ["NFC", "Replace", "Lowercase"]
    if drops and plain and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
        return "words"
    return "whole"


def kept_by_worker(kind: str, path: str, make):
    """``make(path)``, kept by this Python worker from task to task; it goes when the worker stays idle."""
    kept = sys.modules.setdefault(f"_halyard_{kind}", types.ModuleType(f"_halyard_{kind}")).__dict__
    if (timer := kept.pop("timer", None)) is not None:
        timer.cancel()
    made = kept.setdefault("made", {})
    if path not in made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made[path] = make(path)
    return made[path]


def encoder(path: str, generation: int | None = None) -> ChunkEncoder:
    return kept_by_worker("encoders", path, lambda p: ChunkEncoder(p, generation))


def trim() -> None:
    """Give back free memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy() -> None:
    """At a task's end: give back free memory, and soon the caches too unless another task comes."""

    def forget(kept: dict) -> None:
        kept["made"] = {}
        trim()

    trim()
    for name in ("_halyard_encoders", "_halyard_prefixes"):
        if name in sys.modules:
            kept = sys.modules[name].__dict__
            timer = kept["timer"] = threading.Timer(IDLE_S, forget, [kept])
            timer.daemon = True
            timer.start()


def slices(column, most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """An Arrow column of texts a bounded number of characters at a time, nulls as empty texts: first row, texts."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, [text or "" for text in column.slice(at, end - at).to_pylist()]
        at = end
