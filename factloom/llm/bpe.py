"""Tokens of the public tokenizer files, as their library gives them, and the counts of all prefixes.

A text of common characters is cut at blanks; each distinct piece is handled once and remembered in the task.  All other texts, and
texts with a special string, go through the library or its own pre-tokenizer as a whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable
from types import ModuleType

import ahocorasick
import numpy as np
import regex
from tokenizers import Tokenizer

#: characters whose class, case and composition no Unicode version has changed
_COMMON = r"\t\n\r\x20-\x7e¡«°»¿-įı-ſ–—‘’“”…€"
REMEMBERED = 300_000


class Remembered(dict):
    """A dictionary that computes what it lacks.  When it is full, its entries become the old ones, from which those still asked
    for return; so it holds twice ``most`` entries at most."""

    def __init__(self, compute, most: int = REMEMBERED):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def once_per_worker(kind: type, path: str):
    """``kind(path)``, kept for later tasks of the same Python worker."""
    kept = vars(sys.modules.setdefault("_factloom_worker", ModuleType("_factloom_worker")))
    key = f"{kind.__name__}:{path}"
    if key not in kept:
        kept[key] = kind(path)
    return kept[key]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest
    follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenIds:
    """Token ids of whole texts for a tokenizers file (``add_special_tokens=False``).

    A file that lower-cases and splits words by a pattern takes the short way for common texts; any other file and text is left to
    the library.
    """

    #: fixed value: the pattern whose words hold all letters that stand together and no other character
    LETTER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code, self.kind = ("H", "<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.letters = byte_letters()
        self.odd = None
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        if normal == ["NFC", "Replace", "Lowercase"] and split[0].get("type") == "Split" and split[0].get("invert") and split[-1].get("use_regex") is False:
            self.pattern = regex.compile(split[0]["pattern"]["Regex"])
            self.letters_alone = split[0]["pattern"]["Regex"] == self.LETTER_WORDS
            self.odd = re.compile(f"[^{_COMMON}]")
            self.special = [t["content"] for t in spec["added_tokens"]]
            self.words = Remembered(self._word)
            self.pieces = Remembered(self._piece)

    def _word(self, word: str) -> bytes:
        letters = self.letters
        known = word if word.isascii() else "".join([letters[b] for b in word.encode()])  # words hold no control characters
        return array(self.code, [t.id for t in self.model.tokenize(known)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between blanks, in lower case; letters with one other character behind them need no pattern."""
        if self.letters_alone and piece.isalpha():
            return self.words[piece]
        if self.letters_alone and piece[:-1].isalpha():
            return self.words[piece[:-1]] + self.words[piece[-1]]
        return b"".join([self.words[w] for w in self.pattern.findall(piece)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``kind``."""
        if self.odd and not self.odd.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


class PrefixCounts:
    """Number of tokens of every prefix (in code points) of a text, for a byte-level BPE file with the usual word pattern.

    Within a pre-token, the last token of each prefix follows by dynamic programming: it is the one token that ends there and may
    stand after the last token of the prefix before it (two tokens may stand together if they are the encoding of their joined
    text).  The count of a prefix is one more than that of the prefix before its last token.  An automaton over the vocabulary names
    the tokens that end at each place; whether two tokens may stand together follows from the ranks of the merges.
    """

    #: fixed values: the word pattern of byte-level BPE files with ``use_regex``
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    CONTRACTIONS = ("'re", "'ve", "'ll")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space"):
            raise ValueError("prefix counts need a byte-level BPE file without normalizer, with the usual word pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._learn(spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]])
        self.letters = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(self.PATTERN)
        self.common = regex.compile(f"[{_COMMON}]*+")
        self.odd_gap = regex.compile(r"\s\s")
        self.words = Remembered(self._word, 150_000)
        self.first = Remembered(self._piece)
        self.spaced = Remembered(lambda piece: self._piece(" " + piece))

    def _learn(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Tables of the merges by token id: the rank that makes a token (-1 for a letter), its halves, and the rank that joins a pair."""
        most = max(vocabulary.values()) + 1
        self.size, self.rank, self.first_half, self.second_half = [0] * most, [-1] * most, [0] * most, [0] * most
        self.joins: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[made] >= 0 or len(a + b) < 2 or max(self.rank[left], self.rank[right]) >= rank or (len(a) > 1 and self.rank[left] < 0) or (len(b) > 1 and self.rank[right] < 0):
                raise ValueError("prefix counts need merges that make every token once, from tokens made before")
            self.rank[made], self.first_half[made], self.second_half[made] = rank, left, right
            self.joins[left << 32 | right] = rank
        self.tokens = ahocorasick.Automaton()
        self.alone = bytearray(most)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
            if len(token) == 1 or self.rank[i] >= 0:
                self.tokens.add_word(token, i)
        self.tokens.make_automaton()
        for i in sorted(vocabulary.values(), key=self.rank.__getitem__):
            left, right, rank = self.first_half[i], self.second_half[i], self.rank[i]
            self.alone[i] = self.size[i] == 1 or (rank >= 0 and self.alone[left] and self.alone[right] and self._apart(left, right, rank))
        self.together = Remembered(lambda pair: self._apart(pair >> 32, pair & 0xFFFFFFFF, len(merges)))

    def _apart(self, a: int, b: int, below: int) -> bool:
        """Whether no merge of a rank under ``below`` joins the end of token ``a`` with the beginning of token ``b`` before both are
        made.  The merges are undone from the last one back.  Merges of one rank go from left to right, so one on the left comes
        before an equal one across the border, and one on the right after it."""
        rank, joins = self.rank, self.joins
        while joins.get(a << 32 | b, below) >= below:
            if rank[a] > rank[b]:
                a, below = self.second_half[a], rank[a]
            elif rank[b] >= 0:
                b, below = self.first_half[b], rank[b] + 1
            else:
                return True
        return False

    def _prefixes(self, s: str) -> list[int]:
        """Tokens of every prefix of ``s``, given in the letters of the vocabulary."""
        size, alone, together = self.size, self.alone, self.together
        counts: list[int] = []
        last: list[int] = []
        for end, token in self.tokens.iter(s):
            if end < len(counts):
                continue
            before = end - size[token]
            if before < 0:
                if alone[token]:
                    counts.append(1)
                    last.append(token)
            elif together[last[before] << 32 | token]:
                counts.append(counts[before] + 1)
                last.append(token)
        if len(counts) != len(s):
            raise ValueError(f"not all of {s!r} can be written in tokens")
        return counts

    def _word(self, word: str) -> list[int]:
        """Counts of the prefixes of one pre-token."""
        if word.isascii() and word.isprintable():
            return self._prefixes(word.replace(" ", self.letters[32]))
        letters, raw = self.letters, word.encode()
        counts = self._prefixes("".join([letters[b] for b in raw]))
        if len(raw) == len(word):
            return counts
        ends, e = [], -1
        for c in word:
            e += len(c.encode())
            ends.append(counts[e])
        return ends

    def _joined(self, words: Iterable[str]) -> list[int]:
        """Counts of the prefixes of consecutive pre-tokens.  A prefix that ends in white space has all of that white space in one
        pre-token, whatever follows in the text."""
        out: list[int] = []
        base = run_base = 0
        run = ""
        for word in words:
            counts = self.words[word]
            gap = len(word) - len(word.lstrip())
            if gap:
                if not run:
                    run_base = base
                for k in range(gap):
                    run += word[k]
                    out.append(run_base + (self.words[run][-1] if len(run) < 64 else self._word(run)[-1]))
            if gap < len(word):
                run = ""
                if word in self.CONTRACTIONS:
                    out += [base + 1, base + 2, base + counts[-1]]
                else:
                    out += [base + c for c in counts[gap:]]
            base += counts[-1]
            if out:
                out[-1] = base if gap < len(word) else out[-1]
        return out

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
            return array("I", self._word(piece)).tobytes()
        words = self.pattern.findall(piece)
        if "'" in piece or len(piece.split()) != 1 or piece[:2].isspace() or piece[-1].isspace():
            return array("I", self._joined(words)).tobytes()
        out, base, known = [], 0, self.words
        for word in words:
            counts = known[word]
            out += [base + c for c in counts] if base else counts
            base = out[-1]
        return array("I", out).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Counts for a text without special strings."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.common.fullmatch(text):
            if self.odd_gap.search(text):
                return np.array(self._joined(self.pattern.findall(text)), np.uint32)
            head, *rest = text.split(" ")
            pieces = ([self.first[head]] if head else []) + list(map(self.spaced.__getitem__, rest))
            counts = np.frombuffer(b"".join(pieces), "<u4").copy()
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
            totals = counts[np.cumsum(sizes) - 1]
            counts += np.repeat((np.cumsum(totals) - totals).astype(np.uint32), sizes)
            return counts
        places = [p for _, p in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return np.array(self._joined(text[a:b] for a, b in places), np.uint32)

    def counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` for k from 1 on; special strings are one token, as the library takes them by default."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out, at, base = [], 0, 0
        for m in self.special.finditer(text):
            part = self._plain(text[at : m.end() - 1]) + np.uint32(base)
            before = int(part[m.start() - at - 1]) if m.start() > at else base
            base = before + 1
            out += [part, np.array([base], np.uint32)]
            at = m.end()
        out.append(self._plain(text[at:]) + np.uint32(base))
        return np.concatenate(out)
