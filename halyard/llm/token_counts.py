"""Exact token counts of texts and of all their prefixes.

Prefix dynamic programming has for every prefix of a pre-token the last token of its encoding: a prefix's encoding is
that of the prefix before its last token, plus that token, where the two last tokens are ones that byte-pair merging leaves
apart. So count[i] = count[i - length of last[i]] + 1. The counts of every distinct chunk of the texts, at each of its
letters, are stored once as a table; along a text they add up. How many tokens a text has, how many it has when it is cut
anywhere, and where a budget ends are read from the tables; nothing is encoded.

Nulls: a null text is empty; doc_id may be null or repeated, a row for each row. Texts of any length are counted whole.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from halyard.llm.chunks import GENERATION, Known, byte_letters, encoder, kept_by_worker, simple, slices, tidy


#: The tokenizer's white space, which is not quite Python's.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: Lengths in bytes of the prefixes whose state is kept for other words.
KEPT = (5,)


class PrefixTable:
    """Prefix counts for byte-level BPE without normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        model = spec["model"]
        self.vocab = {bytes(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(bytes(back[c] for c in a), bytes(back[c] for c in b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        born = {a + b: k for (a, b), k in self.rank.items()}
        self.ordered = all(born.get(t, -1) < k for pair, k in self.rank.items() for t in pair)  # tokens are made before they are used
        self.grown: dict[bytes, tuple[list, list] | None] = {}
        self.states: dict[bytes, tuple[list[int], list[bytes]]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, list[int]] = {}
        self.tables = Known(self._table, empty=b"\0")
        self.path = path

    @property
    def coder(self):
        return encoder(self.path)

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (pair := (parts[best], parts[best + 1])) not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def growth(self, token: bytes) -> tuple[list, list] | None:
        """How the token's first and last parts grow while its bytes are merged, as (part, rank of the merge that made it);
        None if merging does not give the token."""
        if token not in self.grown:
            parts, first, last = [token[i : i + 1] for i in range(len(token))], [(token[:1], -1)], [(token[-1:], -1)]
            while len(parts) > 1:
                rank, pair = min((self.rank.get(pair, 1 << 40), pair) for pair in zip(parts, parts[1:]))
                if rank == 1 << 40:
                    break
                out: list[bytes] = []
                for part in parts:  # the leftmost of overlapping pairs is merged
                    if out and open_ and (out[-1], part) == pair:
                        out[-1], open_ = out[-1] + part, False
                    else:
                        out.append(part)
                        open_ = True
                first += [(out[0], rank)] if out[0] != parts[0] else []
                last += [(out[-1], rank)] if out[-1] != parts[-1] else []
                parts = out
            self.grown[token] = (first, last) if len(parts) == 1 else None
        return self.grown[token]

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether merging leaves tokens ``a`` (or nothing) and ``b``, side by side, as they are: whether no merge across
        their border comes before the parts at it have grown on."""
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        if not self.ordered:
            stay = self.merged(a + b) == ([a, b] if a else [b])
        elif not a or self.growth(b) is None:
            stay = self.growth(b) is not None
        else:
            lefts, rights, i, j, never = self.growth(a)[1], self.growth(b)[0], 0, 0, 1 << 41
            while True:
                left = lefts[i + 1][1] if i + 1 < len(lefts) else never
                right = rights[j + 1][1] if j + 1 < len(rights) else never
                across = self.rank.get((lefts[i][0], rights[j][0]), never)
                if across < left and across <= right and across < never:
                    stay = False
                    break
                if left == right == never:
                    stay = True
                    break
                i, j = (i + 1, j) if left <= right else (i, j + 1)
        self.apart[a, b] = stay
        return stay

    def counts(self, word: bytes) -> list[int]:
        """Tokens of every prefix of one pre-token, by its bytes. Prefixes that other words had are looked up."""
        if word in self.words:
            return self.words[word]
        count, last = [0], [b""]
        vocab, apart, longest, states = self.vocab, self.apart, self.longest, self.states
        for size in KEPT:
            if size < len(word) and (state := states.get(word[:size])):
                count, last = state[0][:], state[1][:]
                break
        for end in range(len(count), len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = word[start:end]
                if token in vocab:
                    pair = last[start], token
                    if apart[pair] if pair in apart else self.stays(*pair):
                        count.append(count[start] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError("no token ends here")
            if end in KEPT:
                states[word[:end]] = count[:], last[:]
        if len(states) > 200_000:
            states.clear()
        if len(word) < 40:  # parts of chunks recur
            if len(self.words) > 100_000:
                self.words.clear()
            self.words[word] = count
        return count

    def table(self, chunks: list[str]) -> Iterator[Sequence[int]]:
        """The stored counts of each chunk: of its prefixes of 0, 1, ... letters."""
        self.coding = self.coder
        if len(self.tables) > GENERATION:
            self.tables = Known(self._table, self.tables, empty=b"\0")
        return map(self.tables.__getitem__, chunks)

    def _table(self, chunk: str) -> Sequence[int]:
        out = [0]
        if (parts := simple(self.coding, chunk)) is None:
            out = self.text_counts(chunk).tolist()
        elif len(parts) == 1 and chunk[0] != "'":
            out = self.by_letter(chunk)
        else:
            for part in parts:
                base = out[-1]
                if len(part) == 1:  # a letter or mark alone
                    out.append(base + self.by_letter(part)[1])
                    continue
                out += [base + n for n in self.by_letter(part)[1:]]
                if len(part) == 3 and part[0] == "'":  # a contraction in the making: the apostrophe and a letter
                    out[-2] = base + 2
        return bytes(out) if out[-1] < 256 else array("I", out)

    def text_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k from 0 to its length. Special strings count as one token from their end on."""
        out, base, plain = [0], 0, ""
        special = "|".join(map(re.escape, self.coder.marks)) or r"(?!)"
        for piece in re.split(f"({special})", text):
            if piece and re.fullmatch(special, piece):  # a prefix that ends inside it has its start as ordinary text
                before = base - (self._plain(plain)[-1] if plain else 0)
                out += [before + n for n in self._plain(plain + piece)[len(plain) + 1 : -1]] + [base + 1]
                base, plain = base + 1, ""
            elif piece:
                own, plain = self._plain(piece), piece
                out += [base + n for n in own[1:]]
                base += own[-1]
        return np.array(out, np.int64)

    def _plain(self, text: str) -> list[int]:
        out, base = [0] * (len(text) + 1), 0
        tokens = self.coder.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        space = None  # where a run of white space began and the count before it
        for _, (a, b) in tokens:
            word = text[a:b]
            lead = len(word) - len(word.lstrip(WHITE))
            if lead and space is None:
                space = (a, base)
            if space is not None:  # a prefix that ends in the run has it as one pre-token
                run = self.by_letter(text[space[0] : a + lead])
                for k in range(a, a + lead):
                    out[k + 1] = space[1] + run[k + 1 - space[0]]
            own = self.by_letter(word)
            for k in range(lead, len(word)):
                out[a + k + 1] = base + own[k + 1]
            if word[0] == "'" and len(word) == 3:  # a contraction in the making: the apostrophe and a letter
                out[a + 2] = base + 2
            base += own[-1]
            if lead < len(word):
                space = None
        out[-1] = base
        return out

    def by_letter(self, word: str) -> list[int]:
        """Tokens of word[:k]. A prefix always ends between letters."""
        count = self.counts(word.encode())
        if word.isascii():
            return count
        out, end = [0], 0
        for c in word:
            end += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(count[end])
        return out

    def fits(self, chunks: list[str], tables: list[Sequence[int]], limit: int) -> int:
        """Letters of the longest prefix of the chunks' text with at most ``limit`` tokens."""
        total = list(accumulate(map(itemgetter(-1), tables)))
        if not total or total[-1] <= limit:
            return sum(map(len, chunks))
        first = end = bisect_right(total, limit)  # the chunk that the budget ends in
        while first and not chunks[first].strip():  # white space is one pre-token where a prefix ends in it
            first -= 1
        own = tables[end] if first == end else self.text_counts("".join(chunks[first : end + 1])).tolist()
        left = limit - (total[first - 1] if first else 0)
        return sum(map(len, chunks[:first])) + max(k for k, n in enumerate(own) if n <= left)


def table(path: str) -> PrefixTable:
    return kept_by_worker("prefixes", path, PrefixTable)


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row: n_bytes, n_tokens, over_limit, and fits: the letters of its longest prefix within the limit."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        prefixes = table(path)
        coder = prefixes.coder
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                rows = []
                for text in texts:
                    if (own := coder.chunks(text)) is None:
                        total = prefixes.text_counts(text)
                        rows.append((int(total[-1]), int(np.flatnonzero(total <= limit)[-1])))
                        continue
                    tables = list(prefixes.table(own))
                    n = sum(map(itemgetter(-1), tables))
                    rows.append((n, len(text) if n <= limit else prefixes.fits(own, tables, limit)))
                tokens, fits = zip(*rows, strict=True)
                names = batch.column(0).slice(at, len(texts))
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([names, n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row the token count of each prefix of its text, by letters from 0 on."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, texts in slices(batch.column(1), 200_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([table(path).text_counts(t) for t in texts], pa.list_(pa.int64()))], ["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, counts array<long>")
