"""Token ids of whole texts, with a bounded cache of the pieces that a tokenizer treats on their own."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: White space other than space and newline, in the widest sense; texts that hold any are encoded as they are.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")
#: Pieces between which no pre-token of either vocabulary reaches: plain words with the one space before them, marks
#: that end a word, anything else up to white space, and white space.
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ÿ", "-.,!?;:#$%&*"
PIECE = re.compile(f"(?: ?[{LETTER}]+(?=[ \n{MARK}]|\\Z)|[{MARK}]+(?=[ \n]|\\Z)| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+)")
#: The same for a vocabulary that drops white space.
WORD_PIECE = re.compile(f"(?:[{LETTER}]+(?=[ \n{MARK}]|\\Z)|[{MARK}]+(?=[ \n]|\\Z)|[^ \n]+)")
WIDE = re.compile("[^\x00-\xff]")
#: Pieces that are one pre-token of either vocabulary, so that the BPE model alone gives their ids.
ONE_WORD = re.compile(f"(?: ?[{LETTER}]+|[{MARK}]+)\\Z")
#: Pieces longer than this are not kept.
LONG_PIECE = 64


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones of Latin-1 stand for themselves, the
    others in order for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder(dict):
    """Ids of whole texts by a file of the ``tokenizers`` library, the same as if each text were encoded at once.

    Most words of a corpus repeat, so the ids (as bytes) of up to ``most`` pieces are remembered. The strings of special
    tokens in a text are ordinary text. Where the vocabulary folds case and drops white space, so do the pieces.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.most = self.tokenizer.model, byte_letters(), most
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(x["type"] == "Lowercase" for x in steps)
        self.pattern = WORD_PIECE if self.folds and any(x["type"] == "Replace" for x in steps) else PIECE

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if ONE_WORD.match(piece):
            word = (piece.lower() if self.folds else piece).encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            ids = self._whole(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text (null: none)."""
        if not text:
            return np.empty(0, np.uint32)
        if ODD_SPACE.search(text):
            return np.frombuffer(self._whole(text), np.uint32)
        if self.folds and not WIDE.search(text):
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, self.pattern.findall(text))), np.uint32)

    def all_ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return map(self.ids, texts)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file: one for a Python worker, which keeps its pieces from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
