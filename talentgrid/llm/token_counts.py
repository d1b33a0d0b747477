"""Number of tokens of whole texts, by merging the pairs of many pre-tokens at once in arrays.

A text is cut before every single space between two non-space characters; no pre-token crosses such a cut.
Distinct new words are cut into pre-tokens: plain ones by a pattern that was compared with the tokenizer's own
splitting, in one call for all, the others by the tokenizer's splitter. Pre-tokens that
the worker has not met are held as one ragged array of symbols: a round finds the lowest rank among the pairs
of each sequence and merges that pair in all sequences at the same time; sequences without a pair leave, and
their symbols are counted. Sequences are cut beforehand where two bytes stand together in no token, because no
merge can cross such a place. Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from talentgrid.llm.encoding import PLAIN, Encoder
from talentgrid.llm.shared import picked

LIMIT = 512
KNOWN = 400_000  #: words, and pre-tokens, whose counts a worker keeps; beyond it only words met again stay
SYMBOLS = 1 << 18  #: symbols that are merged at once; a longer pre-token is merged alone
SLICE = 4 << 20  #: characters of the texts whose words are brought together at once
_NONE = np.int32(2**31 - 1)
_MAPPED = "\x00"
_SPACE_IN_TEXT = re.compile(r"(?<=\S) (?=\S)")


class Merges:
    """Merge table of a byte-level BPE file (also with a suffix for the last symbol of a word).

    ``look(left, right)``: rank and merged symbol of pairs, from an open-addressing table in arrays.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = [a.removesuffix(suffix) + b for a, b in pairs] if suffix else [a + b for a, b in pairs]
        self.symbol = np.array([vocab[t] for t in joined], np.int32)
        self.size = max(vocab.values(), default=0) + 1
        self._fill(left * self.size + right)
        ranks, made = np.arange(len(pairs)), np.full(self.size, -1, np.int64)
        made[self.symbol] = ranks
        twice = np.bincount(self.symbol, minlength=self.size) > 1
        #: every symbol is made by one merge, before those that use it: all places of a pair merge at once
        self.ordered = bool((made[left] < ranks).all() and (made[right] < ranks).all() and not twice.any())

    def _fill(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        place, left, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[place[left]] == -1]
            self.keys[place[free]] = keys[free]  # of several keys at one place the last stays
            done = self.keys[place[left]] == keys[left]
            self.ranks[place[left[done]]] = left[done]
            left = left[~done]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest integer for pairs that do not merge."""
        keys = left.astype(np.int64) * self.size + right
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.ranks[place], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[place[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merged_counts(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols that remain of each sequence of the ragged array ``symbols``; all ``lengths`` are at least 1."""
    counts = np.array(lengths, np.int64)
    alive, sizes, sym = np.arange(len(counts)), counts.copy(), symbols.astype(np.int32)
    ranks = np.full(len(sym), _NONE, np.int32)
    if len(sym) > 1:
        ranks[:-1] = merges.rank(sym[:-1], sym[1:])
        ranks[np.cumsum(sizes) - 1] = _NONE
    while len(alive):
        starts = np.cumsum(sizes) - sizes
        lowest = np.minimum.reduceat(ranks, starts)
        on = lowest != _NONE
        if not on.all():
            keep = np.repeat(on, sizes)
            sym, ranks = sym[keep], ranks[keep]
            alive, sizes, lowest = alive[on], sizes[on], lowest[on]
            if not len(alive):
                break
            starts = np.cumsum(sizes) - sizes
        at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        owner = np.searchsorted(starts, at, "right") - 1
        if merges.ordered:  # of a run of equal symbols every second pair
            first = np.ones(len(at), bool)
            first[1:] = np.diff(at) != 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            some = (np.arange(len(at)) - run) % 2 == 0
        else:  # the leftmost pair only
            some = np.ones(len(at), bool)
            some[1:] = owner[1:] != owner[:-1]
        at, owner = at[some], owner[some]
        sym[at] = merges.symbol[ranks[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        last = at + 1 == (starts + sizes - 1)[owner]
        sizes = sizes - np.bincount(owner, minlength=len(sizes))
        counts[alive] = sizes
        moved = np.arange(len(at))  # symbols left of a merge that went before it
        sym, ranks, at = sym[stay], ranks[stay], at - moved
        ranks[at] = _NONE
        inner = at[~last]
        ranks[inner] = merges.rank(sym[inner], sym[inner + 1])
        before = at[at > (np.cumsum(sizes) - sizes)[owner]] - 1
        ranks[before] = merges.rank(sym[before], sym[before + 1])
    return counts


class Counter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` does; strings of added tokens in a
    text count one each. ``None`` is the empty text."""

    def __init__(self, path: str, known: int = KNOWN, symbols: int = SYMBOLS):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a byte-level BPE: {path}")
        self.encoder = Encoder(path, added=True)  # opens the file; its rule cuts plain words into pre-tokens
        tokens = self.encoder.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that take in what stands around them are not counted")
        contents = sorted((t.content for t in tokens), key=len, reverse=True)
        # an added token that is sought in the normalized text is found in any spelling that normalizes to it
        self.anywhere = bool(self.encoder.normalizer) and any(t.normalized for t in tokens)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = Merges(vocab, model["merges"], suffix)
        letters = [c for c in vocab if len(c) == 1]
        self.code = np.zeros(max(map(ord, letters)) + 1, np.int32)
        self.last = np.zeros_like(self.code)
        for c in letters:
            self.code[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        self.apart = np.ones((len(self.code), len(self.code)), bool)  # pairs of letters that no token holds
        for token in vocab:
            for a, b in zip(token, token.removesuffix(suffix)[1:] if suffix else token[1:]):
                if ord(b) < len(self.code):
                    self.apart[ord(a), ord(b)] = False
        self.room, self.symbols = known, symbols
        #: counts of pre-tokens: plain ones as they stand, others in the tokenizer's alphabet after a null character
        self.pieces: dict[str, int] = {}
        self.heads: dict[str, int] = {}  # first words of texts
        self.words: dict[str, int] = {}  # other words, without the space before them

    def _learn(self, pieces: list[str]) -> None:
        """Counts of pre-tokens that are not known yet."""
        letters_of = [p[1:] if p[0] == _MAPPED else self.encoder.signs_of(p) for p in pieces]
        at = 0
        while at < len(pieces):
            begin, size = at, 0
            while at < len(pieces) and (at == begin or size + len(letters_of[at]) <= self.symbols):
                size += len(letters_of[at])
                at += 1
            part = letters_of[begin:at]
            letters = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(lengths)
            sym = self.code[letters]
            sym[ends - 1] = self.last[letters[ends - 1]]
            stop = np.ones(len(letters), bool)
            stop[:-1] = self.apart[letters[:-1], letters[1:]]
            stop[ends - 1] = True
            cuts = np.flatnonzero(stop) + 1
            found = merged_counts(sym, np.diff(cuts, prepend=0), self.merges)
            first = np.searchsorted(cuts, ends - lengths, "right")
            self.pieces.update(zip(pieces[begin:at], np.add.reduceat(found, first).tolist()))

    def _split(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of each word; plain words by one call of the rule, the others by the tokenizer's splitter."""
        out: list[list[str]] = [[] for _ in words]
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)] if self.encoder.rule else []
        if plain:
            pattern, lower = self.encoder.rule
            joined = _MAPPED.join([words[i] for i in plain])
            found = re.findall(f"{pattern.pattern}|{_MAPPED}", joined.lower() if lower else joined)
            at = 0
            for i in plain:
                try:
                    end = found.index(_MAPPED, at)
                except ValueError:
                    end = len(found)
                out[i] = found[at:end]
                at = end + 1
        for i in set(range(len(words))).difference(plain):
            word = self.encoder.normalizer.normalize_str(words[i]) if self.encoder.normalizer else words[i]
            out[i] = [_MAPPED + p for p, _ in self.encoder.split(word)]
        return out

    def _learn_words(self, words: list[str]) -> list[int]:
        split = self._split(words)
        if len(self.pieces) > self.room:
            self.pieces.clear()
        self._learn([*set().union(*split).difference(self.pieces)])
        known = self.pieces
        return [known[x[0]] if len(x) == 1 else sum([known[p] for p in x]) for x in split]

    def _counts(self, texts: list[str]) -> list[int]:
        heads, rests = [], []
        for t in texts:
            head, *rest = t.split(" ")
            heads.append(head)
            rests.append(rest)
        seen = set().union(*rests)
        if len(self.words) > self.room:  # words that are met again stay
            self.words = {w: self.words[w] for w in seen.intersection(self.words)}
        if len(self.heads) > self.room:
            self.heads.clear()
        new = seen.difference(self.words)
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        new -= odd
        for i, t in enumerate(texts):
            if not heads[i] or heads[i][-1].isspace() or not odd.isdisjoint(rests[i]):
                # beside other white space a space may belong to a longer pre-token
                heads[i], *rests[i] = _SPACE_IN_TEXT.split(t)
                new.update(rests[i])
        fresh = [*new.difference(self.words)]
        self.words.update(zip(fresh, self._learn_words([" " + w for w in fresh])))
        fresh = [*set(heads).difference(self.heads)]
        self.heads.update(zip(fresh, self._learn_words(fresh)))
        known = self.words.__getitem__
        out = [self.heads[h] + sum(map(known, rest)) for h, rest in zip(heads, rests)]
        for w in new:  # only words without white space at an end tell regular texts from the others
            if w[-1].isspace():
                del self.words[w]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text."""
        out = [0] * len(texts)
        parts: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            if t and self.anywhere:
                out[i] = len(self.encoder.library(t, add_special_tokens=False).ids)
            elif t and self.added is not None and self.added.search(t):
                sections = self.added.split(t)
                out[i] = len(sections) - 1
                parts.extend((i, s) for s in sections if s)
            elif t:
                parts.append((i, t))
        at = 0
        while at < len(parts):
            some, size = [], 0
            while at < len(parts) and (not some or size + len(parts[at][1]) <= SLICE):
                some.append(parts[at])
                size += len(parts[at][1])
                at += 1
            for (i, _), n in zip(some, self._counts([t for _, t in some])):
                out[i] += n
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter for each tokenizer file and worker process."""
    return Counter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    for given in batches:
        texts = given.column("text")
        n = pa.array(counter(path).count(texts.to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [given.column("id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)],
            ["id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``tokenizer``: a byte-level BPE file that all executors have. A null or empty text has no bytes and no
    tokens; repeated and null ids are rows of their own; no rows give no rows; other columns are left out, so
    their names cannot clash. Texts of any length are counted whole.
    """
    rows = picked(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _count(it, tokenizer, limit),
                           f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
