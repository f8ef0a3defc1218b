"""Token ids of texts by a ``tokenizers`` file, exact and cached, for use inside tasks."""

from __future__ import annotations

import re
from functools import lru_cache

CHUNKS, PRETOKENS = 600_000, 800_000  # entries that a worker keeps; a full cache is emptied

# The split pattern of byte-level vocabularies of this kind, and the bytes that stand for themselves in
# their alphabet; the other bytes are written as the characters from 256 on, in order.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit integers, equal to encoding the whole text.

    The vocabulary's split pattern never joins what lies before a space that a non-space follows with what lies after
    it, so a text may be cut there, and its chunks, which repeat a lot, are looked up. A new chunk is split by that
    pattern, and a new piece goes through the file's model. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, chunks: int = CHUNKS, pretokens: int = PRETOKENS):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(PATTERN).findall
        others = [b for b in range(256) if b not in PRINTABLE]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}
        self.after_space: dict[str, bytes | None] = {}
        self.pretokens: dict[str, bytes] = {}
        self.cut = re.compile(r"(?= \S)")
        self.most_chunks, self.most_pretokens = chunks, pretokens

    def encode(self, text: str | None) -> bytes:
        """The ids of the text; none for a null or empty one."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            found = list(map(self.after_space.__getitem__, rest))
        except KeyError:
            self._learn(rest)
            found = list(map(self.after_space.__getitem__, rest))
        if None in found:  # a run of white space: cut only where one space stands before a word
            return b"".join(self._ids(chunk) for chunk in self.cut.split(text) if chunk)
        return (self._ids(head) if head else b"") + b"".join(found)

    def forget(self) -> None:
        """Give back the memory of words."""
        self.after_space.clear(), self.pretokens.clear()

    def _learn(self, chunks: list[str]) -> None:
        if len(self.after_space) > self.most_chunks:
            self.after_space.clear()
        for chunk in {c for c in chunks if c not in self.after_space}:
            self.after_space[chunk] = self._ids(" " + chunk) if chunk and not chunk[0].isspace() else None

    def _ids(self, chunk: str) -> bytes:
        known, out = self.pretokens, []
        for piece in self.split(chunk):
            ids = known.get(piece)
            if ids is None:
                if len(known) > self.most_pretokens:
                    known.clear()
                written = piece.encode().decode("latin1").translate(self.alphabet)
                ids = known[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str, chunks: int = CHUNKS, pretokens: int = PRETOKENS) -> Encoder:
    """One per worker process and file; it is made where the work is, as each machine has the file at ``path``."""
    return Encoder(path, chunks, pretokens)
