"""A full-text index over a set of texts, and matching statistics by backward
search, for many patterns at a time with numpy.

The index holds the Burrows-Wheeler transform of the joined texts in a wavelet
matrix (one packed bit vector with rank counts for each bit of a symbol), the
suffix array sorted by the first ``2 * limit`` characters or more, and longest
common prefixes capped there, with their nearest smaller values, from which
the parent of an interval follows. Matches are followed to ``limit``
characters: for windows of that length the result is exact. The transform is
compressed; suffix array, prefixes and intervals are kept whole beside it, 28
bytes a character, which is why an index has a bounded number of characters.
"""

from __future__ import annotations

import numpy as np

#: Windows that are looked up in one piece of a pattern.
PIECE = 480


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(seq), bits
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(int(self.n - bit.sum()))
            one = bit.astype(bool)
            cur = np.concatenate([cur[~one], cur[one]])
        # where the symbols of each value start after the last level
        self.first = np.zeros((1 << bits) + 1, np.int64)
        where, at = np.unique(cur, return_index=True)
        self.first[where] = at

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        for k in range(self.bits):
            ones = self._ones(k, i)
            set_ = (symbol >> (self.bits - 1 - k)) & 1
            i = np.where(set_ == 1, self.zeros[k] + ones, i - ones)
        return i - self.first[symbol]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each key), equal keys having equal ranks."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    step = np.empty(len(keys), np.int32)
    step[0] = 0
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(step, dtype=np.int32)
    return order, rank


class FMIndex:
    """texts: arrays of code points. limit: the length to which matches are followed."""

    def __init__(self, texts: list[np.ndarray], limit: int) -> None:
        self.limit = limit
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, t.dtype))])
        self.alphabet, codes = np.unique(joined, return_inverse=True)  # 0 ends a text; code points of texts are above
        n = len(codes)
        self.text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        bits = max(1, int(len(self.alphabet) - 1).bit_length())

        # suffixes sorted by doubling, from as many characters as fit one key
        per = 1
        while per * 2 * bits <= 62:
            per *= 2
        keys = np.zeros(n, np.int64)
        for k in range(per):
            keys <<= bits
            keys[: max(0, n - k)] |= codes[k:]
        order, rank = _ranks(keys)
        steps, h = [(per, rank)], per
        while h <= limit:
            keys = rank.astype(np.int64) * (n + 1)
            keys[: max(0, n - h)] += rank[h:] + 1
            order, rank = _ranks(keys)
            h *= 2
            steps.append((h, rank))
        self.sa = order.astype(np.int32)
        self.n = n
        self.lcp = self._lcp(codes, steps, per)
        self.smaller_left, self.smaller_right = (x.astype(np.int32) for x in _nearest_smaller(self.lcp))
        bwt = codes[order - 1]
        self.wavelet = WaveletMatrix(bwt, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.alphabet)))])
        # intervals of suffixes that share ``limit`` characters
        cut = np.flatnonzero(self.lcp[:-1] < limit)
        ends = np.append(cut[1:], n)
        run = np.repeat(np.arange(len(cut)), ends - cut)
        self.run_start, self.run_end = cut[run].astype(np.int32), ends[run].astype(np.int32)

    def _lcp(self, codes: np.ndarray, steps: list[tuple[int, np.ndarray]], per: int) -> np.ndarray:
        """lcp[i]: characters that suffixes i - 1 and i have in common (capped); -1 at both ends."""
        a, b = self.sa[:-1].astype(np.int64), self.sa[1:].astype(np.int64)
        out = np.zeros(self.n - 1, np.int32)
        for h, rank in reversed(steps):
            inside = np.flatnonzero((a + h <= self.n) & (b + h <= self.n))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            a[same] += h
            b[same] += h
            out[same] += h
        left = np.arange(self.n - 1)
        for _ in range(per):
            left = left[(a[left] < self.n) & (b[left] < self.n)]
            left = left[codes[a[left]] == codes[b[left]]]
            out[left] += 1
            a[left] += 1
            b[left] += 1
        lcp = np.full(self.n + 1, -1, np.int32)
        lcp[1:-1] = out
        return lcp

    def encode(self, text: np.ndarray) -> np.ndarray:
        """Symbols of a pattern; -1 for characters that the index does not have."""
        at = np.searchsorted(self.alphabet, text)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == text, at, -1)

    def windows(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, start, run): every window of ``limit`` characters of a
        pattern that occurs in the index, with the start of its interval in
        the suffix array; run_end has the interval's end.

        Matching statistics: all patterns are read from their ends at once. A
        step extends the match by a character to the left; where that is
        impossible the match gives up characters on its right (the parent
        interval). At ``limit`` characters the match is kept at that length.
        """
        limit, top = self.limit, self.n
        # long patterns are read in pieces that share limit - 1 characters, so that all end at about the same step
        pieces = [(k, s) for k, p in enumerate(patterns) for s in range(0, max(1, len(p) - limit + 1), PIECE)]
        whole = [self.encode(p) for p in patterns]
        coded = [whole[k][s : s + PIECE + limit - 1] for k, s in pieces]
        offset = np.concatenate([[0], np.cumsum([len(c) for c in coded])[:-1]]).astype(np.int64)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        at = np.array([len(c) for c in coded], np.int64)  # characters not read yet
        ids = np.flatnonzero(at >= limit)
        lo, hi, size = np.zeros(len(coded), np.int64), np.full(len(coded), top, np.int64), np.zeros(len(coded), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(ids):
            c = flat[offset[ids] + at[ids] - 1]
            known = c > 0
            sym = np.where(known, c, 0)
            n = len(ids)
            both = self.wavelet.rank(np.concatenate([sym, sym]), np.concatenate([lo[ids], hi[ids]]))
            new_lo, new_hi = self.before[sym] + both[:n], self.before[sym] + both[n:]
            good = known & (new_lo < new_hi)
            g = ids[good]
            lo[g], hi[g] = new_lo[good], new_hi[good]
            size[g] += 1
            at[g] -= 1
            full = g[size[g] >= limit]
            if len(full):
                lo[full], hi[full] = self.run_start[lo[full]], self.run_end[lo[full]]
                size[full] = limit
                out.append((full, at[full], lo[full]))
            bad = ids[~good]
            if len(bad):
                # nothing matched: the character itself is passed over
                none = bad[size[bad] == 0]
                at[none] -= 1
                some = bad[size[bad] > 0]
                if len(some):
                    left, right = self.lcp[lo[some]], self.lcp[hi[some]]
                    keep = np.maximum(np.maximum(left, right), 0)
                    new_lo = np.where(left >= keep, self.smaller_left[lo[some]], lo[some])
                    new_hi = np.where(right >= keep, self.smaller_right[hi[some]], hi[some])
                    lo[some] = np.where(keep == 0, 0, new_lo)
                    hi[some] = np.where(keep == 0, top, new_hi)
                    size[some] = keep
                # an unknown character ends every match that would hold it
                lost = bad[flat[offset[bad] + np.maximum(at[bad], 1) - 1] <= 0]
                lo[lost], hi[lost], size[lost] = 0, top, 0
            ids = ids[at[ids] + size[ids] >= limit]  # others can hold no window any more
            ids = ids[at[ids] > 0]
        if not out:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        piece, start, run = (np.concatenate(x) for x in zip(*out))
        origin = np.array(pieces, np.int64)
        return origin[piece, 0], start + origin[piece, 1], run


def _nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index the nearest one to the left, and to the right, with a smaller value; both ends hold the least."""
    n = len(lcp)
    left = np.arange(-1, n - 1)
    left[0] = 0
    todo = np.arange(1, n)
    while len(todo := todo[lcp[left[todo]] >= lcp[todo]]):
        todo = todo[left[todo] > 0]
        left[todo] = left[left[todo]]
    right = np.arange(1, n + 1)
    right[-1] = n - 1
    todo = np.arange(0, n - 1)
    while len(todo := todo[lcp[right[todo]] >= lcp[todo]]):
        todo = todo[right[todo] < n - 1]
        right[todo] = right[right[todo]]
    return left, right
