"""Words and word shingles of text columns as 64-bit hashes, in numpy.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lowered. A word's hash is a polynomial over
random byte values modulo 2**64, taken from prefix sums over the whole buffer, then mixed; a
shingle's hash combines those of its words in order. Texts are worked off in slices of about ``SLICE`` bytes cut at
white space, so a task needs about ten times a slice, plus 8 bytes per word of the text at hand.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 19
_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWERED = BYTES[LOWER]
STRIP = np.zeros(256, bool)  # ASCII characters that are neither letter nor digit
STRIP[:128] = [not chr(i).isalnum() for i in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class WordHasher:
    """Hashes the words of Arrow string columns. ``plain``: bytes that are ASCII but no letter or digit part words too."""

    def __init__(self, plain: bool = False):
        self.space = SPACE | STRIP if plain else SPACE
        self.up = self.down = np.ones(1, np.uint64)

    def _hash(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start positions of the words of a slice; no word runs across a position in ``cuts``."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1)
        word = ~self.space[data]
        edge = np.ones(n + 1, bool)  # a word may start here
        edge[1:n] = ~word[:-1]
        edge[cuts[(cuts >= 0) & (cuts < n)]] = True
        starts = np.flatnonzero(word & edge[:n])
        after = np.ones(n, bool)  # the word ends with this byte
        after[:-1] = ~word[1:] | edge[1:n]
        ends = np.flatnonzero(word & after)
        if len(starts) == 0:
            return np.zeros(0, np.uint64), starts
        sums = np.cumsum(LOWERED[data] * self.up[:n])
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return mix((sums[ends] - before) * self.down[starts] + (ends - starts + 1).astype(np.uint64)), starts

    def groups(self, column):
        """Yield ``(first row, hashes, offsets)``: the words of rows first .. first + len(offsets) - 2 of an Arrow column."""
        n = len(column)
        if n == 0:
            return
        width = np.int64 if "large" in str(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if column.null_count:  # a null may leave bytes behind
            column = column.fill_null("")
            yield from self.groups(column)
            return
        row = 0
        while row < n:
            last = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1)
            if at[last] - at[row] <= 2 * SLICE:
                hashes, starts = self._hash(data[at[row] : at[last]], at[row : last + 1] - at[row])
                yield row, hashes, np.searchsorted(starts, at[row : last + 1] - at[row])
            else:  # one long text
                parts, here = [], at[row]
                while here < at[last]:
                    end = min(here + SLICE, at[last])
                    while end < at[last]:  # up to the next white space
                        gap = np.flatnonzero(self.space[data[end : min(end + SLICE, at[last])]])
                        if len(gap):
                            end += int(gap[0])
                            break
                        end = min(end + SLICE, at[last])
                    parts.append(self._hash(data[here:end], np.zeros(1, np.int64))[0])
                    here = end
                hashes = np.concatenate(parts)
                yield row, hashes, np.array([0, len(hashes)])
            row = last


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row and the row of each.

    A row of fewer words, but at least one, has its whole sequence as one shingle, if ``short``.
    """
    counts = np.diff(offsets)
    n = len(words)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        out += words[j : j + len(out)] * PLACES[j]
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: len(out)] == row[k - 1 :] if len(out) else np.zeros(0, bool)
    hashes, rows = mix(out[inside]), row[: len(out)][inside]
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        own = []
        for i in few:
            part = words[offsets[i] : offsets[i + 1]]
            own.append((part * PLACES[: len(part)]).sum() + np.uint64(len(part)))
        hashes = np.concatenate([hashes, mix(np.array(own, np.uint64))])
        rows = np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def distinct(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted within it, and their offsets. ``rows`` must ascend."""
    offsets = np.searchsorted(rows, np.arange(n_rows + 1))
    kept, sizes = [], np.zeros(n_rows, np.int64)
    for i in np.flatnonzero(np.diff(offsets)):
        part = np.sort(hashes[offsets[i] : offsets[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        kept.append(part)
        sizes[i] = len(part)
    return (np.concatenate(kept) if kept else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
