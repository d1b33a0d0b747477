"""Token ids of whole texts with a public tokenizer file, with a bounded cache of words.

Both tokenizer families used here break a text before every single space that stands between two
non-space characters, so the ids of a text are the ids of such words in order. Words repeat, so each
worker keeps the ids of the words that it has met; the new words of many texts are encoded together. A new word
of plain Latin letters, digits and signs is cut into pieces by a pattern that is compared with the
tokenizer's own splitting when the file is opened; every other word goes through the tokenizer's steps.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

WORD_CACHE = 600_000  #: words, and pieces, kept by one worker; beyond it only those met again stay
SLICE = 4 << 20  #: characters of the texts whose words are brought together at once
_BETWEEN = "\x00"  #: stands between plain words, which do not hold it
_SPACE_IN_TEXT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf" ?[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
#: Pieces of a plain word (pattern, lower-cased before): with the space before it, or without spaces.
_PIECES = (
    (re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n"), False),
    (re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+"), True),
)
_PROBES = (" Foo.\nBar", "x!!", " 12a", "É,b34", " a-b_c", "  ", " $$$", "9\n8", " ÀÖØÞß", "A.\n.B")


class _Signs(dict):
    """Characters in the tokenizer's alphabet of bytes, filled as they are met."""

    def __init__(self, split):
        self.split = split

    def __missing__(self, c: int) -> str:
        self[c] = "".join(p for p, _ in self.split(chr(c)))
        return self[c]


class Encoder:
    """Encodes texts; results equal ``Tokenizer.encode(text, add_special_tokens=False)``. ``None`` counts as the
    empty text.

    ``added``: strings of added tokens in a text get the tokens' ids, as the library does unless told otherwise;
    such texts are encoded by the library itself. Without it they are ordinary text (``encode_special_tokens``).
    """

    def __init__(self, path: str, capacity: int = WORD_CACHE, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokens = list(tokenizer.get_added_tokens_decoder().values()) if added else []
        # a token that is sought in the normalized text may be in any text
        contents = {"" if t.normalized and tokenizer.normalizer else t.content for t in tokens}
        self.added = re.compile("|".join(map(re.escape, sorted(contents)))) if contents else None
        self.tokenizer, self.library = tokenizer, tokenizer.encode
        tokenizer.encode_special_tokens = not added
        self.normalizer = tokenizer.normalizer
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.tokenize = tokenizer.model.tokenize
        self.capacity = capacity
        self.signs = _Signs(self.split)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.rule = None
        for rule in _PIECES:
            if all(self._plain(rule, p) == self._pieces(p) for p in _PROBES if PLAIN.fullmatch(p)):
                self.rule = rule
                break

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text by the tokenizer's own steps."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [piece for piece, _ in self.split(text)]

    def _plain(self, rule, word: str) -> list[str]:
        pattern, lower = rule
        return [self.signs_of(p) for p in pattern.findall(word.lower() if lower else word)]

    def signs_of(self, piece: str) -> str:
        """The piece in the tokenizer's alphabet of bytes."""
        return piece.translate(self.signs)

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _encode(self, text: str) -> bytes:
        if self.rule is None or not PLAIN.fullmatch(text):
            return b"".join(map(self._ids, self._pieces(text)))
        pattern, lower = self.rule
        out = []
        for piece in pattern.findall(text.lower() if lower else text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= self.capacity:
                    self.pieces.clear()
                ids = self.pieces[piece] = self._ids(self.signs_of(piece))
            out.append(ids)
        return b"".join(out)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, given with the space before it, if any; plain words are cut by one call for all."""
        out = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)] if self.rule else []
        if plain:
            pattern, lower = self.rule
            joined = _BETWEEN.join([words[i] for i in plain])
            found = re.findall(f"{pattern.pattern}|{_BETWEEN}", joined.lower() if lower else joined)
            seen = set(found)
            if len(self.pieces) >= self.capacity:
                self.pieces = {p: self.pieces[p] for p in seen.intersection(self.pieces)}
            pieces, tokenize, signs = self.pieces, self.tokenize, self.signs
            pieces[_BETWEEN] = b""
            for piece in seen.difference(pieces):
                pieces[piece] = array("I", [t.id for t in tokenize(piece.translate(signs))]).tobytes()
            ids, at = list(map(pieces.__getitem__, found)), 0
            found.append(_BETWEEN)
            for i in plain:
                end = found.index(_BETWEEN, at)
                out[i] = ids[at] if end == at + 1 else b"".join(ids[at:end])
                at = end + 1
        for i in set(range(len(words))).difference(plain):
            out[i] = b"".join(map(self._ids, self._pieces(words[i])))
        return out

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        known, heads, rests = self.words, [], []
        for t in texts:
            first, *rest = t.split(" ")
            heads.append(first)
            rests.append(rest)
        seen = set().union(*rests)
        if len(known) >= self.capacity:  # words that are met again stay
            known = self.words = {w: known[w] for w in seen.intersection(known)}
        new = seen.difference(known)
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        new = list(new - odd)
        known.update(zip(new, self.encode_words([" " + w for w in new])))
        firsts = list(set(heads))
        first_ids = dict(zip(firsts, self.encode_words(firsts)))
        out = []
        for t, first, rest in zip(texts, heads, rests):
            if first and first[-1].isspace() or odd and not odd.isdisjoint(rest):
                # beside other white space a space may belong to a longer piece
                first, *rest = _SPACE_IN_TEXT.split(t)
                out.append(self._encode(first) + b"".join(
                    known[w] if w in known else self._encode(" " + w) for w in rest))
            else:
                out.append(first_ids[first] + b"".join(map(known.__getitem__, rest)))
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [b""] * len(texts), 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < SLICE:
                if (text := texts[at]) and self.added is not None and self.added.search(text):
                    out[at] = array("I", self.library(text, add_special_tokens=False).ids).tobytes()
                elif text:
                    some.append(at)
                    size += len(text)
                at += 1
            for i, ids in zip(some, self._encode_slice([texts[i] for i in some])):
                out[i] = ids
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return self.encode_all([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker process, with the library's defaults."""
    return Encoder(path, added=True)
