"""Token ids of whole texts by a public tokenizer, with its results kept per white-space chunk.

The word-BPE vocabulary drops white space and never merges across it, so the ids of a text are the ids of its
chunks one after another. :class:`ChunkEncoder` asks the tokenizer once per distinct chunk and joins the answers.
Texts with characters for which that isn't proven (beyond Latin letters, combining marks, odd controls, or the
vocabulary's special strings) are given to the tokenizer whole.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Printable ASCII, tab, newline, return, and Latin-1/Latin Extended letters except those whose lower case is longer.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*\Z")
CACHE = 300_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's split of a text, for plain characters.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def _load(path: str) -> tuple:
    """The tokenizer, the same merges for pieces that are already split, its special strings, and which ids end a piece."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary = whole.get_vocab(with_added_tokens=True)
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return whole, bare, [t.content for t in whole.get_added_tokens_decoder().values()], closes


class ChunkEncoder:
    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.bare, self.special, self.closes = _load(path)
        self.cache, self.known = cache, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: all are encoded as one text, which the ids that end a piece cut up again."""
        if not pieces:
            return []
        mapped = [p if p.isascii() else p.encode().decode("latin-1").translate(LETTERS) for p in pieces]
        ids = np.asarray(self.bare.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        ends = np.concatenate([[0], np.flatnonzero(self.closes[np.frombuffer(ids, "<u4")]) + 1]) * 4
        if len(ends) - 1 != len(pieces) or ends[-1] != len(ids):
            return self._whole(pieces)
        at = ends.tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks that aren't known, from those of their pieces (a piece is a chunk of itself)."""
        known = self.known
        split = {c: (c,) if c.isascii() and c.isalpha() else PIECES.findall(c) for c in chunks}
        new = list({p for own in split.values() for p in own if p not in known})
        fresh = dict(zip(new, self._pieces(new)))
        if len(known) < self.cache:  # common words come early, and a full cache stays as it is
            known.update(fresh)
        for c, own in split.items():
            if c not in fresh:
                fresh[c] = b"".join([fresh.get(p) or known[p] for p in own])
        if len(known) < self.cache:
            known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. The collector of reference cycles rests meanwhile: none
        arise here, and it would walk through all known ids again and again."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, lacking = self.known.get, set()
        found: list[tuple[list, list[str], list[int]] | None] = []  # ids, chunks, and which of them aren't known
        for text in texts:
            if not PLAIN.match(text) or any(s in text for s in self.special):
                found.append(None)
                continue
            own = text.lower().split()
            ids, missing = list(map(get, own)), []
            if None in ids:
                at = ids.index(None)
                while at >= 0:
                    missing.append(at)
                    lacking.add(own[at])
                    try:
                        at = ids.index(None, at + 1)
                    except ValueError:
                        at = -1
            found.append((ids, own, missing))
        fresh = self._chunks(lacking)
        whole = iter(self._whole([t for t, f in zip(texts, found) if f is None]))
        out = []
        for one in found:
            if one is None:
                out.append(next(whole))
                continue
            ids, own, missing = one
            for at in missing:
                ids[at] = fresh[own[at]]
            out.append(b"".join(ids))
        return out
