"""Encoding of single white-space separated words by a public tokenizer, with a bounded cache per worker.

For a tokenizer that drops white space, a text's tokens are those of its words one after the other: cutting at ASCII
white space never changes them. That makes the word the unit of reuse. Used inside tasks only.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Entries kept per worker before the cache is started anew; some 250 bytes each.
CACHE_WORDS = 300_000
#: Pieces of words that are kept; most words are kept whole.
CACHE_PIECES = 100_000

#: Printable ASCII and the Latin-1 letters whose lower case and composition need no context (fixed values).
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own word pattern, for such characters in lower case (fixed values).
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordEncoder:
    """``encode(word)`` gives (number of tokens, decimal ids joined by a space, decoded text); both as bytes."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {code: to_bytes(chr(code))[0][0] for code in range(0xDF, 0x100)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.pieces: dict[str, tuple[int, bytes, bytes]] = {}

    def encode(self, word: bytes) -> tuple[int, bytes, bytes]:
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            known = self.words[word] = self._encode(word.decode())
        return known

    def _encode(self, word: str) -> tuple[int, bytes, bytes]:
        if SIMPLE.fullmatch(word) and not any(s in word for s in self.special):
            return joined([self._piece(p) for p in PIECE.findall(word.lower())])
        found = self.tokenizer.encode(word, add_special_tokens=False)
        return shown(found.ids, self.tokenizer.id_to_token)

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            tokens = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
            known = self.pieces[piece] = (
                len(tokens),
                b" ".join(b"%d" % t.id for t in tokens),
                " ".join(t.value for t in tokens).encode(),
            )
        return known


def shown(ids: list[int], token_of) -> tuple[int, bytes, bytes]:
    return len(ids), b" ".join(b"%d" % i for i in ids), " ".join(token_of(i) for i in ids).encode()


def joined(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    """Encodings of consecutive stretches as one; the tokenizer's decoding joins tokens by a space."""
    parts = [p for p in parts if p[0]]
    return sum(p[0] for p in parts), b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts])


@lru_cache(maxsize=2)
def encoder(definition: str) -> WordEncoder:
    """One encoder per worker process and tokenizer."""
    return WordEncoder(definition)


def definition_at(path: str) -> str:
    """The tokenizer file's content, sent to the workers with the task: they need not have the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def drops_white_space(definition: str) -> bool:
    """Whether the two rules that the cut at white space relies on hold: white space is replaced by one space before
    words are found, and the word pattern matches no white space while everything else is removed."""
    import json

    rules = json.loads(definition)
    parts = (rules.get("normalizer") or {}).get("normalizers", [])
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return any(p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " " for p in parts) and (
        split.get("behavior") == "Removed" and split.get("invert") is True
    )
