"""Opaque page cursors: where the previous page ended, bound to its sort and filters."""

from __future__ import annotations

import binascii
import hashlib
from base64 import b64decode, urlsafe_b64encode
from collections.abc import Iterable
from dataclasses import dataclass

from gleanframe.plans.filters import Filter

#: The form of the token; another form has another letter.
FORM = "a"


def _digest(text: str) -> str:
    return hashlib.blake2s(text.encode(), digest_size=6).hexdigest()


def filter_fingerprint(filters: Iterable[Filter]) -> str:
    return _digest("\n".join(sorted(repr(f) for f in filters)))


@dataclass(frozen=True)
class Cursor:
    """``key`` is the sort value as text (see ``key_text``), None when it is null or unsorted.

    A token is five words with dots between them: the form, digests of the page's order and of its
    filters, the row id, and the key, ``-`` for none.
    """

    sort: str | None
    descending: bool
    rowid: int
    key: str | None
    filters: str

    def _bound_to(self) -> dict[str, str]:
        """Words that a token of this page sequence begins with, with what another word means."""
        direction = "down" if self.descending else "up"
        return {
            "Invalid cursor version": FORM,
            "Cursor does not match current sort": _digest(f"{direction} {self.sort!r}"),
            "Cursor does not match current filters": self.filters,
        }

    def encode(self) -> str:
        key = "-" if self.key is None else "=" + urlsafe_b64encode(self.key.encode()).decode().rstrip("=")
        return ".".join([*self._bound_to().values(), f"{self.rowid:x}", key])

    @classmethod
    def decode(cls, token: str, sort: str | None, descending: bool, filters: str) -> "Cursor":
        """Read a token and reject it when it belongs to another page sequence."""
        words = token.split(".") if isinstance(token, str) else []
        if len(words) != 5:
            raise ValueError("Invalid cursor")
        *bound, rowid, key = words
        for (problem, expected), word in zip(cls(sort, descending, 0, None, filters)._bound_to().items(), bound):
            if word != expected:
                raise ValueError(problem)
        try:
            at = int(rowid, 16)
            padded = key[1:] + "=" * (-len(key[1:]) % 4)
            text = b64decode(padded, altchars=b"-_", validate=True).decode() if key[:1] == "=" else None
        except (ValueError, binascii.Error) as exc:
            raise ValueError("Invalid cursor") from exc
        if text is None and key != "-":
            raise ValueError("Invalid cursor")
        return cls(sort, descending, at, text, filters)
