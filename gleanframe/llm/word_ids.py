"""Token ids of words, kept in a table of bounded size that outlives a task.

Most words of a corpus are repeats. A table from word to packed ids turns encoding into one look-up a word,
and the tokenizer only sees words that the table does not hold. The table has two halves: when the newer is full it
becomes the older, whose words come forward when they are met again. So its memory is bounded
whatever the vocabulary, common words stay, and what it holds never changes the ids.
"""

from __future__ import annotations

import os
import struct
import sys
import types

import numpy as np

#: Words in each half of a table at most, and characters of a word that is kept.
WORDS = 400_000
LONGEST = 64
# Signs that never share a token with the letter before them.
SIGNS = ".,;:!?%&*#$|)"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def load(tokenizer: str):
    """The tokenizer of a path, or of a name among the installed public files."""
    # Spark has a task for every core already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))


def kind_of(model, *others: int) -> np.dtype:
    """The narrowest little-endian type for all ids of a vocabulary and some more."""
    last = max(model.get_vocab_size(with_added_tokens=True) - 1, *others)
    return np.dtype("<u4" if last > 0xFFFF else "<u2")


class WordIds(dict):
    """Packed ids by word: ``table[word]`` encodes what it does not hold.

    ``before`` stands before each word when it is encoded; ``fold`` says that the tokenizer ignores case.
    """

    def __init__(self, model, kind: np.dtype, before: str = "", fold: bool = False, limit: int = WORDS):
        super().__init__()
        self.model, self.merges, self.letter = model, model.model, kind.char.upper()
        self.before, self.fold, self.limit = before, fold, limit
        self.unit_before = before.translate(BYTE_LETTERS)
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _whole(self, text: str) -> bytes:
        return self.pack(self.model.encode(text, add_special_tokens=False).ids)

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            if len(self.signs) >= self.limit:
                self.signs.clear()
            self.signs[signs] = self._whole(signs)
        return self.signs[signs]

    def _find(self, word: str) -> bytes:
        """A run of Latin letters is one unit of the merges; signs after it are units of their own."""
        if not word:
            return b""
        stem = word.rstrip(SIGNS)
        if not stem.isalpha() or max(stem) > "\xff":
            return self._whole(self.before + word)
        if len(stem) < len(word):
            return self[stem] + self._signs(word[len(stem) :])
        if self.fold and not word.islower():
            return self[word.lower()] if word.lower() != word else self._whole(self.before + word)
        unit = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self.pack([t.id for t in self.merges.tokenize(self.unit_before + unit)])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._find(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def of_process(name: str, make):
    """What ``make()`` returned first in this Python process, which serves many tasks one after another."""
    key = f"gleanframe {name}"
    if key not in sys.modules:
        sys.modules[key] = types.ModuleType(key)
        sys.modules[key].value = make()
    return sys.modules[key].value


#: Bytes of text that are encoded at once; a longer text is encoded alone.
CHUNK = 1 << 20


def chunks(batch, column: int, most: int = CHUNK):
    """Slices of an Arrow batch with about ``most`` bytes of text at most."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
