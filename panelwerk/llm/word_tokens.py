"""Token ids and token counts of the lower-casing word tokenizer, by its library, chunk by chunk.

The tokenizer drops white space, and neither its normaliser nor its pre-tokenizer looks across it, so a text's ids are the
ids of its space-separated chunks in order. Chunks repeat far more often than they differ: a worker keeps what it has
encoded, within a bound, and the library encodes only new chunks. Special strings hold no white space and no case
change, so they too stay inside one chunk and are matched by the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: The default vocabulary file; a path to another of the same kind may be given.
WORD_BPE = "word_bpe_49k.json"
#: Chunks that a worker remembers; beyond that it starts anew (a batch's own chunks are held in any case).
KEPT = 700_000


def chunks(text: str) -> list[str]:
    """A text cut at ASCII spaces and line ends (any other white space stays for the library)."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Kept:
    """What was made for a piece of text, remembered within a bound; a batch's new pieces are made together."""

    def __init__(self, make: Callable[[list[str]], Iterable]):
        self.known: dict = {}
        self.make, self.get = make, self.known.__getitem__

    def learn(self, pieces: Iterable[str]) -> None:
        """Have every one of ``pieces`` ready."""
        wanted = set(pieces)
        if len(self.known) + len(wanted) > KEPT:
            self.known.clear()
        new = list(wanted.difference(self.known))
        if new:
            self.known.update(zip(new, self.make(new), strict=True))


@cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


def ids_together(tokenizer: Tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces that the tokenizer never joins across a space, by one call, and where each piece's ids end."""
    made = tokenizer.encode(" ".join(pieces), add_special_tokens=False)
    starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
    at = np.fromiter((a for a, _ in made.offsets), np.int64, len(made.ids))
    owner = np.searchsorted(starts, at, side="right") - 1
    return np.array(made.ids, dtype=np.uint32), np.cumsum(np.bincount(owner, minlength=len(pieces)))


def encode_texts(kept: Kept, texts: Iterable[str]) -> list[bytes]:
    """The ids of each text, in the bytes that ``kept`` makes for a chunk."""
    parts = [chunks(t) for t in texts]
    kept.learn(chain.from_iterable(parts))
    return [b"".join(map(kept.get, p)) for p in parts]


#: In lower-cased lines: a chunk that is one run of Latin-1 letters and then, perhaps, one of ASCII marks (these are its pre-tokens; no
#: apostrophe, as it may start a pre-token with letters), or else any other chunk.
LINES = re.compile("^(?:([a-zß-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)|(.*))$", re.M).findall


class PreTokens:
    """Ids of single pre-tokens, many by one call: each of them ends with a token that closes a word."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.closes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.closes[[i for piece, i in tokenizer.get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]] = True

    def __call__(self, pres: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each pre-token's ids end."""
        made = self.tokenizer.encode_batch_fast([" ".join(pres)], add_special_tokens=False)[0]
        ids = np.array(made.ids, dtype=np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pres):
            raise ValueError("not single pre-tokens")
        return ids, ends


def parted(pieces: list[str]) -> list[tuple[str, str, str]]:
    """For each chunk its two pre-tokens (either may be empty) and nothing, if it is a simple one; else the chunk in the third place."""
    return LINES("\n".join(pieces).lower())


@cache
def chunk_encoder(path: str, kind: str = "<u4") -> Kept:
    """Chunk to ids, as bytes of ``kind``; a worker keeps it from task to task."""
    tokenizer = library(path)
    width = np.dtype(kind).itemsize
    encode = PreTokens(tokenizer)

    def cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data = ids.astype(kind).tobytes()
        return [data[width * a : width * b] for a, b in pairwise([0, *ends.tolist()])]

    pres = Kept(lambda new: cut(*encode(new)))

    def make(pieces: list[str]) -> list[bytes]:
        parts = parted(pieces)
        pres.learn(p for a, b, rest in parts if not rest for p in (a, b) if p)
        pres.known[""] = b""
        known = pres.known
        other = [k for k, (_, _, rest) in enumerate(parts) if rest]
        made = [b"" if rest else known[a] + known[b] for a, b, rest in parts]
        if other:
            for k, ids in zip(other, cut(*ids_together(tokenizer, [pieces[k] for k in other])), strict=True):
                made[k] = ids
        return made

    return Kept(make)


def whole_tokens(path: str) -> frozenset[str]:
    """Offline proof: the pre-tokens, in the vocabulary's byte characters, that are one token on their own.

    Every vocabulary entry that ends a word is tried: it is kept only if the library's model makes exactly this one token of the
    string without the word's end. A pre-token that is in the set counts 1 without any merge.
    """
    model = library(path).model
    ends = [(piece[:-4], i) for piece, i in library(path).get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]
    return frozenset(text for text, i in ends if text and [t.id for t in model.tokenize(text)] == [i])


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Bytes that are printable in Latin-1 stand for themselves; the others get the code points from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_CHARACTERS = byte_characters()


def byte_string(text: str) -> str:
    """A text as the vocabulary writes its UTF-8 bytes."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(_CHARACTERS)


def chunk_counter(path: str, whole: frozenset[str]) -> Kept:
    """Chunk to its number of tokens: pre-tokens proven whole count 1, only the rest are merged.

    Simple chunks are cut into their pre-tokens here, all others by the library's normaliser and pre-tokenizer. Only a chunk that
    holds a special string is left to the library as it is.
    """
    tokenizer = library(path)
    encode = PreTokens(tokenizer)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    latin = Kept(lambda new: np.diff(encode(new)[1], prepend=0).tolist())
    bytewise = Kept(lambda new: [len(tokenizer.model.tokenize(p)) for p in new])

    def make(pieces: list[str]) -> list[int]:
        parts = parted(pieces)
        is_whole = {p: not p or byte_string(p) in whole for p in {p for a, b, rest in parts if not rest for p in (a, b)}}
        latin.learn(p for p, yes in is_whole.items() if not yes)
        size = lambda pre: bool(pre) if is_whole[pre] else latin.known[pre]
        made = [0 if rest else size(a) + size(b) for a, b, rest in parts]
        cut = {}
        for k in (k for k, (_, _, rest) in enumerate(parts) if rest):
            if any(s in pieces[k] for s in special):
                made[k] = len(tokenizer.encode(pieces[k], add_special_tokens=False).ids)
            else:
                cut[k] = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(pieces[k]))]
        bytewise.learn(p for p in chain.from_iterable(cut.values()) if p not in whole)
        for k, pres in cut.items():
            made[k] = sum(1 if p in whole else bytewise.known[p] for p in pres)
        return made

    return Kept(make)


def count_texts(kept: Kept, texts: Iterable[str]) -> list[int]:
    parts = [chunks(t) for t in texts]
    kept.learn(chain.from_iterable(parts))
    return [sum(map(kept.get, p)) for p in parts]
