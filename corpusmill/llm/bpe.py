"""Counts of byte-pair tokens without writing the tokens down.

The vocabulary becomes an Aho-Corasick automaton. At each end of a match, one token alone can
be the last of the encoding of what was read so far: the one that is compatible with the last
token before it. Two tokens are compatible if merging their joined bytes never merges across
the border. So a count takes one pass over the bytes, whatever the length of a piece.
"""

from __future__ import annotations

import base64
import os
from pathlib import Path

import ahocorasick
import regex

#: Folder of the public tokenizers; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The piece pattern that the public byte-level vocabularies were trained with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker remembers.
REMEMBERED = 200_000


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    """The vocabulary file; under 1 MB, so it may be broadcast."""
    return Path(folder, name).read_bytes()


class Counter:
    """Exact token counts under a byte-level BPE vocabulary whose ids are its merge ranks."""

    def __init__(self, file: bytes, pattern: str = PATTERN) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.bytes = {r: b for b, r in self.rank.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, r in self.rank.items():
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()
        self.right: dict[int, list[int]] = {}
        self.left: dict[int, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        whole = self.bytes[token]
        if len(whole) == 1:
            return None
        parts = [self.rank[whole[i : i + 1]] for i in range(len(whole))]
        while len(parts) > 2:
            best = min((self.rank.get(self.bytes[parts[i]] + self.bytes[parts[i + 1]], token), i) for i in range(len(parts) - 1))
            if best[0] >= token:
                raise ValueError(f"token {token} cannot be made by merges")
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def _edge(self, token: int, side: int, kept: dict[int, list[int]]) -> list[int]:
        """Tokens that stand at one edge of a token while it is being made, in that order."""
        if token not in kept:
            halves = self._halves(token)
            kept[token] = [token] if halves is None else [*self._edge(halves[side], side, kept), token]
        return kept[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b."""
        if (a, b) in self.pairs:
            return self.pairs[a, b]
        xs, ys = self._edge(a, 1, self.right), self._edge(b, 0, self.left)
        i = j = 0
        never = 1 << 60
        out = True
        while True:
            across = self.rank.get(self.bytes[xs[i]] + self.bytes[ys[j]], never)
            nx = xs[i + 1] if i + 1 < len(xs) else never
            ny = ys[j + 1] if j + 1 < len(ys) else never
            if across < nx and across <= ny:  # of equal ranks the leftmost merges first
                out = False
                break
            if nx == never and ny == never:
                break
            if nx <= ny:
                i += 1
            else:
                j += 1
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        self.pairs[a, b] = out
        return out

    def piece(self, piece: str) -> int:
        """Tokens of one piece."""
        data = piece.encode("utf-8", "surrogatepass")
        if data in self.rank:
            return 1
        last: list[int] = [-1] * (len(data) + 1)
        count = [0] * (len(data) + 1)
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - size
                before = last[start]
                if start == 0 or (before >= 0 and self.compatible(before, token)):
                    last[end + 1], count[end + 1] = token, count[start] + 1
        return count[-1]

    def __call__(self, text: str) -> int:
        """Tokens of a text; 0 for an empty one."""
        known, total = self.known, 0
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= 64:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total
