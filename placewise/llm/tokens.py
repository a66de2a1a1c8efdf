"""Token ids of whole texts by a public tokenizer file, inside Arrow tasks.

The library is slow on long texts and fast on words it has seen.  Texts are cut
at single spaces, where every tokenizer used here starts a new word whatever
stands before, and each distinct piece is encoded by the library once.  Words of
ASCII letters alone need no normaliser and no pattern to be told apart, so they
go to the library's model parted by spaces.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces after a space, and other parts, kept for one tokenizer in a worker; beyond it the store starts anew.
KEPT_PIECES, KEPT_PARTS = 1_200_000, 300_000
#: A special token of both vocabularies: the library cuts a text there before anything else.
SEPARATOR = "<|endoftext|>"
#: White space right before a space: the tokenizer may join the two, so such a text is encoded whole.
_JOINED_SPACE = re.compile(r"\s ")
#: The letters a piece starts with.  Both tokenizers end a run of letters where the letters end.
_LETTERS = re.compile(r"[^\W\d_]+")
#: A space before a word, as a byte-level model writes it.
_BYTE_SPACE = "\u0120"


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers, equal to encoding the whole text."""

    def __init__(self, path: str, spaced: bool) -> None:
        """``spaced``: a word's ids depend on the space before it (byte-level vocabularies)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that only need to be told apart.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.separator_id = self.tokenizer.token_to_id(SEPARATOR)
        self.spaced = spaced
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # Tokens that start a spaced word, or that end a word: they tell where a word among many starts or ends.
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(_BYTE_SPACE) if spaced else t.endswith("</w>"))]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_words(self, words: list[str], ids: np.ndarray) -> bool:
        """Takes the ids of words in a row apart; false if they can't be told apart."""
        cuts = np.flatnonzero(self.edge[ids])
        if len(cuts) != len(words):
            return False
        data = ids.tobytes()
        cuts = (4 * (cuts if self.spaced else cuts + 1)).tolist()
        starts, ends = (cuts, [*cuts[1:], len(data)]) if self.spaced else ([0, *cuts[:-1]], cuts)
        self.known.update(zip(words, [data[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        return True

    def _learn_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without a space before them, parted by a special token in one call."""
        data, clean = {}, [p for p in parts if SEPARATOR not in p]
        if clean:
            ids = self._ids(self.tokenizer, SEPARATOR.join(clean))
            whole, start = ids.tobytes(), 0
            for part, end in zip(clean, [*np.flatnonzero(ids == self.separator_id).tolist(), len(ids)], strict=True):
                data[part] = whole[4 * start : 4 * end]
                start = end + 1
        return [data[p] if p in data else self.whole(p) for p in parts]

    def _learn(self, pieces: set[str]) -> None:
        """Adds pieces to the store, each with a space before it, by the word they start with and what follows it."""
        known, match = self.known, _LETTERS.match
        words = {p for p in pieces if p.isalpha()}
        split, tails, other = [], set(), []
        if len(words) < len(pieces):
            for piece in pieces.difference(words):
                letters = match(piece)
                end = letters.end() if letters else 0
                # Cut only before an ASCII sign: others may combine with the letter before them.
                if not end or piece[end:] >= "\x80" or SEPARATOR in piece:
                    other.append(piece)
                    continue
                split.append((piece, end))
                tails.add(piece[end:])
                if piece[:end] not in known:
                    words.add(piece[:end])
        ascii_words = [w for w in words if w.isascii()]
        if ascii_words:
            if self.spaced:
                text = _BYTE_SPACE + f" {_BYTE_SPACE}".join(ascii_words)
            else:
                text = " ".join(ascii_words).lower()
            if self._learn_words(ascii_words, self._ids(self.plain, text)):
                words.difference_update(ascii_words)
        if words:
            rest = list(words)
            text = " " + " ".join(rest) if self.spaced else " ".join(rest)
            if not self._learn_words(rest, self._ids(self.tokenizer, text)):
                other += rest
        if other:
            space = " " if self.spaced else ""
            known.update(zip(other, self._learn_parts([space + p for p in other]), strict=True))
        if split:
            parts = self._parts(tails)
            known.update([(p, known[p[:end]] + parts[p[end:]]) for p, end in split])

    def _parts(self, wanted: set[str]) -> dict[str, bytes]:
        """A store that has the ids of ``wanted``, without a space before them."""
        missing = list(wanted.difference(self.parts))
        if missing:
            if len(self.parts) > KEPT_PARTS:
                self.parts.clear()
                missing = list(wanted)
            self.parts.update(zip(missing, self._learn_parts(missing), strict=True))
        return self.parts

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.spaced and _JOINED_SPACE.search(text):
            return self.whole(text)
        known, pieces = self.known, text.split(" ")
        # Nothing stands before the first piece.
        first = self._parts({pieces[0]})[pieces[0]]
        del pieces[0]
        missing = set(pieces).difference(known)
        if missing:
            if len(known) > KEPT_PIECES:
                known.clear()
                missing = set(pieces)
            self._learn(missing)
        return first + b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker process and file."""
    return Encoder(path, spaced)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
