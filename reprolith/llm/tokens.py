"""Exact tokenisation for the public vocabularies.

Byte-level BPE (``BytePairEncoder``). Where the vocabulary's rank file lies beside the library's
file, an equal encoder over the same vocabulary does the work; a text that holds the special string,
or a long run of white space, goes to the library itself.

Piece BPE (``PieceCounter``). No vocabulary string of the model has the space mark after another
character (`prove_split` checks that over the whole vocabulary), so no merge can cross from a
character to a following space mark: a text may be cut there, and each pre-token counted alone.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import re
from collections.abc import Iterable

#: Counts of pre-tokens that a worker keeps; the table starts anew beyond it.
CACHE = 200_000
#: Longer pre-tokens are not kept.
CACHED_CHARS = 48
SPECIAL = "<|endoftext|>"
#: White space in a row costs the fast encoder its square, and beyond about a million characters its stack.
LONG_BLANK = 256
_LONG_BLANK, _TWO_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}"), re.compile(r"\s\s")


def has_long_blank(text: str) -> bool:
    """Whether LONG_BLANK characters of white space are in a row; two of any samples half that apart would fall into them."""
    return bool(_TWO_BLANK.search(text[:: LONG_BLANK // 2]) and _LONG_BLANK.search(text))


def public_path(name: str) -> str:
    """The installed vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePairEncoder:
    """Ids of byte-level BPE as the tokenizers library gives them, special strings included."""

    def __init__(self, json_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        assert self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16, "ids are kept in 16 bits"
        self._ranked = self._encoder(json_path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _encoder(ranks: str):
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> array.array:
        """The whole text's ids, unsigned 16-bit."""
        if self._ranked is None or SPECIAL in text or has_long_blank(text):
            return array.array("H", self.library.encode(text, add_special_tokens=False).ids)
        return array.array("H", self._ranked(text))


@functools.lru_cache(maxsize=2)
def byte_encoder(json_path: str) -> BytePairEncoder:
    """One encoder for each worker process."""
    return BytePairEncoder(json_path)


class PieceCounter:
    """Token counts of a SentencePiece model without encoding what is known beforehand.

    `whole`: vocabulary strings proved, once for each worker, to encode alone as one token; a
    pre-token among them counts one at once. Others are merged by the library, and their counts kept.
    """

    MARK = "▁"

    def __init__(self, model_path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._pieces = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.splits = self.prove_split(self._pieces)
        self.whole = self.prove_whole()
        self._known: dict[str, int] = dict.fromkeys(self.whole, 1)

    @classmethod
    def prove_split(cls, pieces: Iterable[str]) -> bool:
        """No vocabulary string has the space mark after another character: texts may be cut there."""
        return not any(cls.MARK in p.lstrip(cls.MARK) for p in pieces)

    def prove_whole(self) -> frozenset[str]:
        """Vocabulary strings `mark + word`, as `word`, that encode alone as that one token."""
        words = [(i, p[1:]) for i, p in enumerate(self._pieces) if p.startswith(self.MARK) and len(p) > 1 and self.MARK not in p[1:]]
        got = self._model.encode([w for _, w in words], num_threads=1)
        return frozenset(w for (i, w), ids in zip(words, got, strict=True) if ids == [i])

    def count(self, text: str) -> int:
        """Tokens of the whole text, as `encode` of the library has them."""
        if not text:
            return 0
        if not self.splits:
            return len(self._model.encode(text, num_threads=1))
        text = text.replace(self.MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in re.findall(" +[^ ]*", " " + text)]
        else:
            chunks = text.split(" ")
        counts = list(map(self._known.get, chunks))
        if None not in counts:
            return sum(counts)
        missing = [c for c, n in zip(chunks, counts, strict=True) if n is None]
        merged = list(map(len, self._model.encode([c or " " for c in missing], num_threads=1)))
        if len(self._known) >= CACHE + len(self.whole):
            self._known = dict.fromkeys(self.whole, 1)
        self._known.update((c, n) for c, n in zip(missing, merged, strict=True) if len(c) <= CACHED_CHARS)
        return sum(n for n in counts if n is not None) + sum(merged)


@functools.lru_cache(maxsize=2)
def piece_counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)
