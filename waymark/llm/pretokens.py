"""Texts cut into the pre-tokens of the public byte-level vocabularies, and their token ids.

The pattern is that of the vocabulary files' description: contractions, then an optional space with letters, with
digits or with other signs, then white space. Texts of ASCII and Latin letters, which need only a class for each
byte, are cut by array operations on whole batches; a text with any other character goes through the library.
"""

from __future__ import annotations

import base64
from array import array
from functools import cached_property, lru_cache

import numpy as np
import regex

LETTER, DIGIT, OTHER, BLANK, SPACE = range(5)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _pattern() -> regex.Pattern:
    # Fixed: the pre-token pattern of the vocabulary.
    return regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def plain_cut(text: str) -> list[bytes]:
    """The pre-tokens of any text, by the pattern itself."""
    return [x.encode("utf-8", "replace") for x in _pattern().findall(text)]


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[list(b"\t\n\r\x0b\x0c")] = BLANK
    kind[0x20] = SPACE
    kind[list(b"0123456789")] = DIGIT
    kind[list(range(65, 91)) + list(range(97, 123))] = LETTER
    return kind


_KIND = _classes()
#: Other than ASCII (less the separators 0x1c-0x1f) and the letters U+00C0-U+024F without the two signs among them.
_ODD = regex.compile(r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]")


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes of plain texts, where their pre-tokens begin (with the end), and how many each text has.

    Every text must be free of the characters that :func:`is_odd` looks for.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(raw), np.int64)
    kind = _KIND[data]
    kind[data >= 0x80] = LETTER
    bounds = np.cumsum([0, *map(len, raw)])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    white = kind >= BLANK
    # Last of a run of white space before a visible sign, in the same text.
    ends_run = white & ~np.append(white[1:], True) & ~edge[1:]
    joins = ends_run & (kind == SPACE)  # a space that the next pre-token takes
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = np.where(white[1:], ~white[:-1], kind[1:] != kind[:-1])
    begins[1:] &= ~joins[:-1]
    begins |= joins | ends_run  # \s+(?!\S) leaves the last one before a visible sign
    begins |= edge[:-1]
    for quote in np.flatnonzero((data[:-1] == 0x27) & (kind[1:] == LETTER)).tolist() if n > 1 else ():
        _contraction(data, kind, edge, begins, quote)
    starts = np.flatnonzero(begins)
    count = np.diff(np.searchsorted(starts, bounds))
    return data, np.append(starts, n), count


def _contraction(data: np.ndarray, kind: np.ndarray, edge: np.ndarray, begins: np.ndarray, at: int) -> None:
    """A quote that begins a pre-token and is followed by one of the endings ends after it."""
    if not begins[at] or edge[at + 1]:
        return
    tail = data[at + 1 : at + 3].tobytes()
    size = 2 if tail in (b"re", b"ve", b"ll") and not edge[at + 2] else 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 0
    if not size:
        return
    begins[at + 1 : at + 1 + size] = False
    if at + 1 + size < len(data):
        begins[at + 1 + size] = True


def is_odd(text: str) -> bool:
    return _ODD.search(text) is not None


class _Known(dict):
    """Pre-tokens to their numbers; the ids of number i are ``flat[begin[i]:begin[i + 1]]``. New ones are added on the way."""

    def __init__(self, piece) -> None:
        super().__init__()
        self.piece, self.flat, self.begin = piece, array("I"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self.flat.extend(self.piece(word))
        self.begin.append(len(self.flat))
        self[word] = number = len(self.begin) - 2
        return number


class Ids:
    """Token ids of texts under a byte-level vocabulary; remembers the ids of up to ``held`` pre-tokens between batches."""

    def __init__(self, path: str, ranks_path: str, held: int = 200_000) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._piece = tiktoken.Encoding("plain", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._path = path
        self._known, self._held = _Known(self._piece), held

    @cached_property
    def _whole(self):
        """Read only if a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
        plain = [i for i, t in enumerate(texts) if "<|endoftext|>" not in t and not is_odd(t)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.array(self._whole.encode(texts[i].encode("utf-8", "replace").decode(), add_special_tokens=False).ids, np.uint32)
        data, starts, count = cut([texts[i] for i in plain])
        if len(self._known) > self._held:
            self._known = _Known(self._piece)
        body, at = data.tobytes(), starts.tolist()
        number = np.fromiter(map(self._known.__getitem__, map(body.__getitem__, map(slice, at, at[1:]))), np.int64, len(at) - 1)
        begin = np.array(self._known.begin)
        size = begin[number + 1] - begin[number]
        ends = np.cumsum(size)
        where = np.repeat(begin[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        flat = np.array(self._known.flat, np.uint32)[where]
        stops = np.append(0, ends)[np.cumsum(count)]
        for i, a, b in zip(plain, [0, *stops.tolist()], stops.tolist(), strict=False):
            out[i] = flat[a:b]
        return out


@lru_cache(2)
def ids(path: str, ranks_path: str) -> Ids:
    """One for each worker process and vocabulary."""
    return Ids(path, ranks_path)
