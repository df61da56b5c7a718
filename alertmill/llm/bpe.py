"""Byte-level BPE inside tasks: the vocabulary file, whole encodings, forced cuts, overlapping chunks.

The file is a tokenizers .json with a ByteLevel pre-tokenizer and decoder. Its ids come from tiktoken with
the same ranks and pattern, several times as fast; tests hold them against the tokenizers library, over
every code point too. Special strings inside texts are found, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The pre-tokenizer's published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The published byte-to-character rule: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Characters from which on the next forced boundary ends a fragment: a few dozen words, whatever the text's length.
FRAGMENT_CHARS = 256
#: Kinds of characters in the pattern: others, white space, letters, numbers.
_OTHER, _SPACE, _LETTER, _NUMBER = range(4)
#: Whether the pattern, wherever it began, may be cut between two kinds: before white space and never after it (it joins what
#: follows), not from others to letters (contractions) and not inside a run of others (it may hide the start of one).
_STARTS_ANEW = np.array([[0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1], [1, 1, 1, 1]], bool)


def is_space(c: str) -> bool:
    """What the pattern's \\s takes; Python's isspace also takes four separators."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    of = {"L": _LETTER, "N": _NUMBER}
    return np.array([_SPACE if is_space(c) else of.get(unicodedata.category(c)[0], _OTHER) for c in map(chr, range(0x110000))], np.uint8)


@functools.cache
def _sides() -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point on the left of a place (256 x kind + last byte) and on the right (256 x kind + first byte)."""
    kind, (first, last, _) = _kinds().astype(np.uint16) * 256, _utf8(np.arange(0x110000, dtype=np.uint32))
    return kind + last, kind + first


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte and number of bytes of each code point."""
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    lead, shift = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32), np.array([0, 0, 6, 12, 18], np.uint32)
    return (lead[size] | points >> shift[size]).astype(np.uint8), np.where(size == 1, points, 0x80 | points & 0x3F).astype(np.uint8), size


class ByteBpe:
    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ends = [(spec.get(k) or {}).get("type") for k in ("pre_tokenizer", "decoder")]
        if spec["model"]["type"] != "BPE" or ends != ["ByteLevel", "ByteLevel"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: not a byte-level BPE")
        of = _byte_of_char()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # tiktoken merges by id, the library by the order of merges: they agree if merges make ids in order.
        made = [ranks[bytes(of[c] for c in a + b)] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.special = added
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.coder = tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.lengths = np.zeros(self.size, np.int64)
        inside = np.zeros((256, 256), bool)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in added.items())]:
            self.lengths[i] = len(token)
            a = np.frombuffer(token, np.uint8)
            inside[a[:-1], a[1:]] = True
        #: apart[a, b]: no token has byte b right after byte a.
        self.apart = ~inside
        #: forced[a, b]: a cut between sides of those numbers (see _sides()).
        self.forced = np.repeat(np.repeat(_STARTS_ANEW, 256, axis=0), 256, axis=1) & np.tile(self.apart, (4, 4))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    # --- forced cuts -------------------------------------------------------------------------------

    def cuts(self, text: str) -> np.ndarray:
        """All places that no encoding has a token across, and whose sides' tokens do not depend on each other.

        The bytes on both sides occur in no token side by side (special ones included), so nothing merges
        across; and the pre-tokenizer starts anew there, or goes on with a run of letters or digits whose
        rest is again such a run (see _STARTS_ANEW).
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        left, right = _sides()
        return np.flatnonzero(self.forced[left[points[:-1]], right[points[1:]]]) + 1

    def fragments(self, text: str, size: int = FRAGMENT_CHARS) -> list[str]:
        """The text cut at forced boundaries, each piece ending at the first one from size characters on (0: at every one); an empty text has none."""
        if len(text) <= size:
            return [text] if text else []
        places = self.cuts(text)
        if size > 1 and len(places):
            chosen, i = [], int(np.searchsorted(places, size))
            while i < len(places):
                chosen.append(places[i])
                i = int(np.searchsorted(places, places[i] + size))
            places = np.array(chosen, np.int64)
        ends = [0, *places.tolist(), len(text)]
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_fragments(self, text: str, size: int = FRAGMENT_CHARS) -> np.ndarray:
        """Each fragment encoded by itself, then concatenated."""
        ids: list[int] = []
        for x in self.fragments(text, size):
            ids.extend(self.coder.encode(x, allowed_special="all"))
        return np.array(ids, np.uint32)

    # --- overlapping chunks ------------------------------------------------------------------------

    def _token_starts(self, text: str) -> np.ndarray:
        """Byte offset of each token of a chunk, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[self.encode(text)])])

    def count(self, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
        """Tokens of a text; chunks encoded; times an overlap was widened.

        Texts longer than chunk are encoded as chunks that overlap. Two neighbours are spliced at a
        common boundary: a stable place (any chunk that holds both sides of a forced boundary starts a token
        there) inside the overlap where both have a token border, and after which both have the same borders
        up to the next stable place. If there is none, the overlap is
        doubled, at most until the right chunk takes in the whole rest of the left one.
        """
        if len(text) <= chunk:
            return len(self.encode(text)), 1, 0
        total, n, widened = 0, 1, 0
        begin, end = 0, chunk  # the left chunk
        left = self._token_starts(text[begin:end])
        skip = 0  # tokens of the left chunk that lie before its own splice
        while True:
            width, over = overlap, False
            while True:
                right_begin = max(begin + 1, end - width)
                right_end = min(len(text), right_begin + max(chunk, 2 * width))
                right = self._token_starts(text[right_begin:right_end])
                n += 1
                at = self._splice(text, begin, end, left, right_begin, right)
                if at is not None:
                    break
                widened += 1
                if over:  # the overlap was the whole left chunk and has no stable place: the chunks are one
                    left, end = self._token_starts(text[begin:right_end]), right_end
                    n += 1
                    break
                width, over = 2 * width, right_begin == begin + 1
            if at is not None:
                total += at[0] - skip
                begin, end, left, skip = right_begin, right_end, right, at[1]
            if end == len(text):
                return total + len(left) - 1 - skip, n, widened

    def _splice(self, text: str, left_begin: int, left_end: int, left: np.ndarray, right_begin: int, right: np.ndarray) -> tuple[int, int] | None:
        """Tokens before the common boundary, in the left and in the right chunk."""
        before = len(text[left_begin:right_begin].encode("utf-8", "surrogatepass"))
        inside = text[right_begin:left_end]
        places = self.cuts(inside)
        if len(places) < 2:
            return None
        sizes = np.concatenate([[0], np.cumsum(_utf8(np.frombuffer(inside.encode("utf-32-le", "surrogatepass"), np.uint32))[2])])
        for a, b in zip(places, places[1:], strict=False):
            i, j = (np.searchsorted(left, before + sizes[x]) for x in (a, b))
            k, m = (np.searchsorted(right, sizes[x]) for x in (a, b))
            if j < len(left) and m < len(right) and left[i] == before + sizes[a] and right[k] == sizes[a] and np.array_equal(left[i : j + 1] - before, right[k : m + 1]):
                return int(i), int(k)
        return None


@functools.cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)
