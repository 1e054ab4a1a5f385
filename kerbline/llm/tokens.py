"""Token ids of whole texts, with the ids of every space-led piece remembered.

The byte-level pattern never lets a token cross a space that stands between two other characters that are not white space:
such a space opens the next piece. So a text whose white space is single spaces and line feeds splits at spaces, and a piece's
ids depend on the piece alone. Any other text goes to the tokenizer whole, and so does one that holds the string of an added token. Pieces seen for the first time are encoded from the
same vocabulary in rank form, whose library is several times faster on short strings; the tests hold both against each other.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import public_tokenizers

#: Pieces remembered in a worker; at the limit the memory starts anew.
MOST_PIECES = 700_000
#: A text without such white space splits at its spaces: each opens a piece that is encoded alone.
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n ")
_READY: dict[tuple[str, str], "Ids"] = {}


class Ids:
    def __init__(self, vocabulary: str, ranks: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        with open(ranks, "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.piece = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={}).encode_ordinary
        self.pieces: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if OTHER_SPACE.search(text) or self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
            self.first.clear()
        head, pieces = parts[0], self.pieces
        if head not in self.first:
            self.first[head] = array("I", self.piece(head)).tobytes()
        del parts[0]
        for x in set(parts).difference(pieces):
            pieces[x] = array("I", self.piece(" " + x)).tobytes()
        return self.first[head] + b"".join(map(pieces.__getitem__, parts))


def ids(vocabulary: str, ranks: str) -> Ids:
    """One per Python worker and vocabulary."""
    if (vocabulary, ranks) not in _READY:
        _READY[vocabulary, ranks] = Ids(vocabulary, ranks)
    return _READY[vocabulary, ranks]
