"""Comparing whole sequences: the longest common subsequence in bits, longest matching blocks by the words that runs have in common."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Hashable, Sequence

#: Lengths of the words that runs are found by: COMMON if a range may have runs of twice that, a longer one if it recurs too often, the shortest if runs are shorter.
WORDS, COMMON = (6, 16, 128, 1024), 16
#: Places of words, for each element, that are too often; pairs of places up to which a range needs no words; longest runs that are looked up whole.
PLACES, TINY, WHOLE = 4, 4_096, 256


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence.

    A row of the usual table is one integer with a bit for each element of b: clear where the table's values step up. An
    element of a moves the steps with an addition and a few logical operations, so whole texts take a pass over a.
    """
    if len(a) < len(b):
        a, b = b, a
    places: dict[Hashable, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_l(a: Sequence[Hashable] | None, b: Sequence[Hashable] | None) -> float:
    """F1 of the longest common subsequence (0 if either is empty or null)."""
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def rouge_exceeds(a: Sequence[Hashable], b: Sequence[Hashable], floor: float) -> bool:
    """Whether rouge_l(a, b) > floor; a common subsequence is no longer than the elements that both have, which are counted first."""
    return bool(a and b) and 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) > floor and rouge_l(a, b) > floor


class SuffixAutomaton:
    """All runs of elements of b[low:high]; a state knows where its runs end first."""

    def __init__(self, b: Sequence[Hashable], low: int, high: int):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [low]
        last = 0
        for at in range(low, high):
            x = b[at]
            now = self._state({}, 0, self.length[last] + 1, at + 1)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.length[q] != self.length[p] + 1:  # only the shorter runs of q end here too
                    shorter = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.end[q])
                    self.link[q] = shorter
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = shorter
                        p = self.link[p]
                    q = shorter
                self.link[now] = q
            last = now

    def _state(self, follows: dict[Hashable, int], link: int, length: int, end: int) -> int:
        self.next.append(follows)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, a: Sequence[Hashable], low: int, high: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest run of a[low:high] that stands in b: of several the first in a, then the first in b."""
        state = size = 0
        best = (low, self.end[0], 0)
        for at in range(low, high):
            x = a[at]
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            if size > best[2]:
                best = (at + 1 - size, self.end[state] - size, size)
        return best


def _letters(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[str, str]:
    """Two strings whose letters are equal where the elements are."""
    if isinstance(a, str) and isinstance(b, str):
        return a, b
    number = {x: i for i, x in enumerate(dict.fromkeys(a), 2)}
    shared = number.keys() & set(b)
    return "".join(chr(number[x]) if x in shared else "\0" for x in a), "".join(chr(number[x]) if x in shared else "\1" for x in b)


def _same(a: str, i: int, b: str, j: int, most: int) -> int:
    """Length of what a from i on and b from j on begin with together, at most `most`."""
    n, step = 0, 32
    while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    while step > 1:
        step //= 2
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return n


def _runs(a: str, b: str, within: tuple[int, int, int, int], word: int) -> list[tuple[int, int, int]] | None:
    """(-size, i, j) of all runs of at least 2 * word - 1 elements that both have and that can't be made longer; None if words recur too often.

    A run of that length holds a word of b that begins at a multiple of its length. Such words are looked up at each place of a.
    """
    alow, ahigh, blow, bhigh = within
    places: dict[str, list[int]] = {}
    for j in range(blow, bhigh - word + 1, word):
        places.setdefault(b[j : j + word], []).append(j)
    out, reach = [], {}
    left = PLACES * (ahigh - alow)
    for i in [i for i in range(alow, ahigh - word + 1) if a[i : i + word] in places]:
        found = places[a[i : i + word]]
        left -= len(found)
        if left < 0:
            return None
        for j in found:
            if reach.get(i - j, -1) > i:  # inside a run that is known
                continue
            before = 0
            while i - before > alow and j - before > blow and a[i - before - 1] == b[j - before - 1]:
                before += 1
            end = i + word + _same(a, i + word, b, j + word, min(ahigh - i, bhigh - j) - word)
            reach[i - j] = end
            if end - i + before >= 2 * word - 1:
                out.append((i - before - end, i - before, j - before))
    return out


def _by_words(a: str, b: str, within: tuple[int, int, int, int], word: int):
    """The matching blocks of at least 2 * word - 1 elements and the ranges left between them; None if words recur too often.

    Runs come longest first and are cut to the range that they lie in. A run lies on one side of a block that isn't shorter, so it
    keeps one piece at most; one that needs no cut is the longest of its range, and of several the first.
    """
    runs = _runs(a, b, within, word)
    if runs is None:
        return None
    heapq.heapify(runs)
    ranges, lows, blocks = [within], [within[0]], []
    while runs:
        n, i, j = heapq.heappop(runs)
        size = -n
        at = max(bisect_right(lows, i) - 1, 0)
        while at < len(ranges) and lows[at] < i + size:
            alow, ahigh, blow, bhigh = ranges[at]
            cut = max(alow - i, blow - j, 0)
            rest = min(size - cut, ahigh - i - cut, bhigh - j - cut)
            if rest == size:
                blocks.append((i, j, size))
                ranges[at : at + 1] = [(alow, i, blow, j), (i + size, ahigh, j + size, bhigh)]
                lows[at : at + 1] = [alow, i + size]
                break
            if rest >= 2 * word - 1:
                heapq.heappush(runs, (-rest, i + cut, j + cut))
                break
            at += 1
    return blocks, ranges


def _by_length(a: str, b: str, within: tuple[int, int, int, int], size: int):
    """The matching blocks of `size` elements, where no run is longer, and the ranges left between them: the first in a, then the first right of it, and so on."""
    alow, ahigh, blow, bhigh = within
    places: dict[str, list[int]] = {}
    for j in range(blow, bhigh - size + 1):
        places.setdefault(b[j : j + size], []).append(j)
    blocks, ranges, i = [], [], alow
    while i + size <= ahigh and blow + size <= bhigh:
        found = places.get(a[i : i + size])
        if found and found[-1] >= blow:
            j = found[bisect_left(found, blow)]
            blocks.append((i, j, size))
            ranges.append((alow, i, blow, j))
            i = alow = i + size
            blow = j + size
        else:
            i += 1
    return blocks, [*ranges, (alow, ahigh, blow, bhigh)]


def _by_places(a: str, b: str, within: tuple[int, int, int, int], most: int) -> tuple[int, int, int]:
    """(i, j, size) of the longest run, at most `most`: of several the first in a, then the first in b. Each place of a asks for a longer one."""
    i, high, blow, bhigh = within
    best, size = (i, blow, 0), 0
    while size < most and i + size < high:
        j = b.find(a[i : i + size + 1], blow, bhigh)
        if j >= 0:
            size += 1
            while i + size < high and (further := b.find(a[i : i + size + 1], j, bhigh)) >= 0:
                j = further
                size += 1
            best = (i, j, size)
        i += 1
    return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(i, j, size) of the longest matching block, of the longest one left of it in both, of that right of it, and so on; in order.

    A range is known to have no run longer than `most`. Runs of many elements are found by their words, all at once; what is left of a range
    is looked up length by length, so texts that repeat themselves take no search for each of their blocks.
    """
    a, b = _letters(a, b)
    out, todo = [], [((0, len(a), 0, len(b)), min(len(a), len(b)))]
    while todo:
        within, most = todo.pop()
        alow, ahigh, blow, bhigh = within
        n, m = ahigh - alow, bhigh - blow
        most = min(most, n, m)
        if not most:
            continue
        if most == n and (at := b.find(a[alow:ahigh], blow, bhigh)) >= 0:
            out.append((alow, at, n))
            continue
        if most == m and (at := a.find(b[blow:bhigh], alow, ahigh)) >= 0:
            out.append((at, blow, m))
            continue
        if n * m <= TINY:
            i, j, size = _by_places(a, b, within, most)
        else:
            words = [w for w in WORDS if 2 * w - 1 <= most]
            words = [w for w in words if w >= COMMON] or words[-1:]
            found = next(((f, 2 * w - 2) for w in words if (f := _by_words(a, b, within, w)) is not None), None)
            i, j, size = (alow, blow, most) if found or not words else SuffixAutomaton(b, blow, bhigh).longest(a, alow, ahigh)
            if not found and 0 < size <= WHOLE:
                found = _by_length(a, b, within, size), size - 1
            if found:
                (blocks, ranges), most = found
                out += blocks
                todo += [(r, most) for r in ranges]
                continue
        if size:
            out.append((i, j, size))
            todo += [((alow, i, blow, j), size - 1), ((i + size, ahigh, j + size, bhigh), size)]
    return sorted(out)


def ratio(a: Sequence[Hashable] | None, b: Sequence[Hashable] | None) -> float | None:
    """Twice the elements in matching blocks over all elements; 1 for two empty sequences, null for null."""
    if a is None or b is None:
        return None
    matched = sum(size for _, _, size in matching_blocks(a, b))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0
