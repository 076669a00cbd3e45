"""Turning many texts into numbers at once, each distinct word of a batch only once.

The usual byte-level pattern begins a new match at every single space or line feed that
stands between other characters. So texts are cut there, the distinct parts are turned into
numbers in one call, and the numbers are put together by position. Texts with any other
white space go through the call whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split before byte-level merges (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Two separators in a row, one at an end, any other white space.
_ODD = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A\z"
)
SLICE_BYTES = 10_000_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of texts of about equal size, ``most`` bytes at most.

    A longer text is a run of its own.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    if not len(size):
        return
    each = size[-1] / max(1, -(-int(size[-1]) // most))
    at = 0
    while at < len(size):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + each + 1, "right")))
        yield at, end - at
        at = end


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    shift = (start - (ends - length)).astype(np.int32 if len(flat) + total < 2**31 else np.int64)
    return flat[np.repeat(shift, length) + np.arange(total, dtype=shift.dtype)]


def _parts(words: list[str], before: str, make, line: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, and how many each has."""
    flat = np.array(make("\n".join([before + w for w in words])), np.uint32)
    ends = np.concatenate([np.flatnonzero(flat == line), [len(flat)]])
    counts = np.diff(ends, prepend=-1) - 1
    return flat[flat != line], counts


def numbers(
    texts: pa.Array, make: Callable[[str], list[int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): text i is ``flat[start[i]:start[i] + length[i]]``.

    ``make`` gives the numbers of a text match by match of SPLIT, and for a line feed that
    is a match one number that no other match has. A null text counts as empty.
    """
    texts = pc.fill_null(texts, "")
    n = len(texts)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    flats, base = [], 0
    (line,) = make("\n")
    if not odd.all():
        plain = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        try:
            feed = words.index("\n")
            words[feed] = "."
        except ValueError:
            feed = -1
        opens = np.zeros(len(codes), bool)
        opens[offsets[:-1]] = True
        opens[1:] |= codes[:-1] == feed
        heads, head = np.unique(codes[opens], return_inverse=True)
        rest = _parts(words, " ", make, line)
        first = _parts([words[i] for i in heads], "", make, line)
        known = np.concatenate([rest[0], first[0], np.array([line], np.uint32)])
        counts = np.concatenate([rest[1], first[1], [1]])
        starts = np.cumsum(counts) - counts
        unit = codes.astype(np.int32)
        unit[opens] = len(words) + head
        unit[codes == feed] = len(counts) - 1
        sizes = counts[unit]
        flats.append(ragged(known, starts[unit], sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        start[~odd], length[~odd] = ends[:-1], np.diff(ends)
        base = int(ends[-1])
    whole = [make(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    sizes = np.array([len(x) for x in whole], np.int64)
    flats.append(np.array([i for x in whole for i in x], np.uint32))
    start[odd], length[odd] = base + np.cumsum(sizes) - sizes, sizes
    return np.concatenate(flats), start, length
