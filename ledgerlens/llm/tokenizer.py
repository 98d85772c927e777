"""Pre-tokens of the word-end BPE vocabulary and a bounded per-worker piece cache.

A pre-token here is a unit that the tokenizers library encodes on its own, so
the ids of a text are the ids of its pre-tokens in order:

* in plain text (printable ASCII but ``'`` and ``<``, Latin-1 letters) the
  library's own pieces: letters, one digit, or a run of other characters, in
  lower case;
* any other word between ASCII white space, whole and unchanged: its accents,
  contractions and special strings are left to the library. Normalisation,
  the split pattern and special strings never reach across white space.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Default vocabulary file; resolved on the machine that encodes.
VOCABULARY = "word_bpe_49k.json"

_PLAIN = re.compile(r"[\x09-\x0d\x20-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]*")
#: For plain text, whose white space is that of ASCII: named by its characters the set is one look-up a character.
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: The same by bytes of UTF-8, as far as a byte tells: 0 white space, 1 letter, 2 digit, 3 other, ...
_WHITE = {*range(0x09, 0x0E), 0x20}
_KIND = bytes(0 if b in _WHITE else 1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
#: ... 1: it makes a word not plain; with the lead byte of Latin-1 letters, the second bytes of its two signs ...
_ODD = bytes(b not in {*_WHITE, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3} - {0x27, 0x3C} for b in range(256))
_LEAD, _SIGNS = 0xC3, (0x97, 0xB7)
#: ... and a plain word's bytes in lower case.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))

_loaded: dict = {}


def pre_token_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``pre_tokens`` of all the texts, one after the other, and where those of each text end."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data or b"")[at[0]:at[-1]])
    at = at - at[0]
    begins = np.zeros(len(raw) + 1, bool)         # where a text begins
    begins[at] = True
    begins = begins[:-1]
    kind, low, odd = (np.frombuffer(raw.translate(t), np.uint8) for t in (_KIND, _LOWER, _ODD))
    keep = kind != 0
    first = kind == 2
    first[1:] |= kind[1:] != kind[:-1]
    first |= begins
    first &= keep
    odd = odd.astype(bool)
    raw = np.frombuffer(raw, np.uint8)
    second = np.flatnonzero(raw[:-1] == _LEAD) + 1
    odd[second[np.isin(raw[second], _SIGNS)]] = True
    if odd.any():      # their words are taken whole and unchanged
        word = begins & keep
        word[1:] |= keep[1:] & ~keep[:-1]
        of = np.cumsum(word, dtype=np.int32)
        whole = np.zeros(int(of[-1]) + 1, bool)
        whole[of[odd]] = True
        whole = whole[of]
        first = np.where(whole, word, first)
        low = np.where(whole, raw, low)
    start = np.flatnonzero(first[keep])
    shown = low[keep]
    units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(shown))), pa.py_buffer(shown))
    return units, np.searchsorted(np.flatnonzero(first), at[1:])


def pre_tokens(text: str) -> list[str]:
    """The units of ``text`` whose piece lists, put together, are the text's."""
    if _PLAIN.fullmatch(text):
        return _PIECE.findall(text.lower())
    out: list[str] = []
    for w in _WORD.findall(text):
        if _PLAIN.fullmatch(w):
            out += _PIECE.findall(w.lower())
        else:
            out.append(w)
    return out


def load(vocabulary: str = VOCABULARY):
    """The library's tokenizer, once per worker process. A bare name is one of the public files."""
    if vocabulary not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.sep in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[vocabulary] = tok
    return _loaded[vocabulary]


def _byte_alphabet() -> dict[int, str]:
    """The characters that byte-level models write bytes as: printable Latin-1 as it is, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """pre-token -> its ids as little-endian unsigned 16-bit bytes.

    Holds two generations of at most ``limit`` entries: when the younger is
    full it becomes the older, so what is used goes on being known.
    """

    #: Bytes or so of the texts whose pre-tokens are looked up together.
    AT_ONCE = 2 << 20

    def __init__(self, vocabulary: str = VOCABULARY, limit: int = 400_000):
        super().__init__()
        self.tok, self.limit, self.older = load(vocabulary), limit, {}
        self.model, self.alphabet = self.tok.model, _byte_alphabet()
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")

    def encode(self, unit: str) -> list[int]:
        """The unit's ids. A plain one is normalised and split already, so the library's model alone is asked."""
        if _PLAIN.fullmatch(unit):
            shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.alphabet)
            return [t.id for t in self.model.tokenize(shown)]
        return self.tok.encode(unit, add_special_tokens=False).ids

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self.older.get(unit)
        if out is None:
            ids = self.encode(unit)
            out = struct.pack(f"<{len(ids)}H", *ids)
        self[unit] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text)))

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text (none null) in order; a pre-token of some megabytes of texts is looked up once."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // self.AT_ONCE)) + 1).tolist(), len(texts)]
        for lo, hi in itertools.pairwise(cuts):
            if hi == lo:
                continue
            units, ends = pre_token_array(texts.slice(lo, hi - lo))
            coded = units.dictionary_encode()
            known = pa.array(list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.large_binary())
            found = known.take(coded.indices)
            _, at, ids = found.buffers()
            ends = np.frombuffer(at, np.int64)[ends].tolist()
            ids = memoryview(ids or b"")
            for start, end in itertools.pairwise([0, *ends]):
                yield bytes(ids[start:end])


def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """The worker's piece cache: kept for later tasks of the same Python worker."""
    key = ("pieces", vocabulary)
    if key not in _loaded:
        _loaded[key] = Pieces(vocabulary)
    return _loaded[key]


def forget(vocabulary: str = VOCABULARY) -> None:
    """Give the worker's piece cache up, for a step that needs the memory and encodes nothing."""
    _loaded.pop(("pieces", vocabulary), None)
