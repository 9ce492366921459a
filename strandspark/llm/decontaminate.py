"""Benchmark decontamination: a CGK random walk turns edit distance into Hamming distance, bit sampling finds candidates.

Texts and benchmark items are sequences of words (ASCII lower case, without punctuation); in scripts that are written without
spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) each character is a word. Items of under five words are found
by exact match of all their words. From every word of a text a walk
of fixed length copies the word under it at each step and moves on or stays by a random bit of step and word; two sequences
with few edits give walks that differ in few places. The words at a few sampled steps are the key of a window. Keys of
windows, from every word of the texts and of the items, are compared for several independent walks, and every
agreement is confirmed by the exact edit distance between the item and the text around it. How many walks an item gets
follows from a target recall at the edits allowed for its length. What they miss is caught exactly: of one piece of an item
more than its allowed edits one has no edit, so runs of words that equal a piece are candidates too.

Benchmarks made from one template share most of their words. A window that many items share leads to none of them, and
their pieces are cut where fewest items have the same. A text that still has many candidates is asked at once for all items
how many of their words it has; candidates that overlap are verified as one stretch.

Walks that meet at a step stay together, so the keys of all windows of a batch come from one backward pass over the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, mix64, parts, slices, spans, table, utf8, written

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Items with fewer words are too short to tell an edited leak from chance: all their words must be there, as they are.
LEAST_WORDS = 5
#: Words of a window, for items under 16 words and for all others: nearly an item's size for short ones; longer items have many
#: windows, and edits miss some of them. (A walk of a long item's size would cost each text as many steps a word.)
WINDOWS = (4, 8)
#: More walks than these are never made; only edits far above the default ask for them.
MOST_WALKS = 64


#: Code points, first and last, of letters that are written without spaces, and of their punctuation.
_SPACELESS = [(0x0E01, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3041, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
_MARKS = [(0x0E2F, 0x0E2F), (0x0E4F, 0x0E4F), (0x0E5A, 0x0E5B), (0x104A, 0x104F), (0x17D4, 0x17DA), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0x0F0B, 0x0F14)]


def _within(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for low, high in ranges:
        out |= (points >= low) & (points <= high)
    return out


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a range of rows, and the offsets of the rows in them."""
    part = _LOWER[data]
    gap = _GAP[part]
    starts, ends, rows = spans(gap, offsets)
    # Letters without spaces have three bytes from E0 (Thai) on, or four; most texts have none.
    wide = np.flatnonzero(part >= 0xE0)
    if len(wide):
        padded = np.append(part, np.zeros(3, np.uint8)).astype(np.int64)
        lead, b, c, d = (padded[wide + k] for k in range(4))
        points = np.where(lead < 0xF0, (lead & 15) << 12 | (b & 63) << 6 | c & 63, (lead & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)
        size = np.where(lead < 0xF0, 3, 4)
        mark = _within(points, _MARKS)
        alone = _within(points, _SPACELESS) & ~mark
        if mark.any() or alone.any():
            for k in range(4):
                gap[wide[mark & (size > k)] + k] = True
            starts, ends, _ = spans(gap, offsets)
            # Words are cut before and after each of these letters.
            cuts = np.concatenate([wide[alone], (wide + size)[alone]])
            starts = np.union1d(starts, cuts[~np.append(gap, True)[cuts]])
            ends = np.union1d(ends, cuts[~np.append(True, gap)[cuts]])
            rows = np.searchsorted(starts, offsets)
    return hashed(part, starts, ends), rows


class Walk:
    """One random walk for windows of about ``words`` words: its steps, and which of them are sampled."""

    def __init__(self, words: int, turn: int, sampled: int):
        self.steps = max(4, words * 3 // 2)
        rng = np.random.default_rng([words, turn])
        chosen = np.sort(rng.choice(self.steps, min(sampled, self.steps), replace=False))
        self.sampled = {int(j): np.uint64(int(rng.integers(1 << 62)) * 2 + 1) for j in chosen}
        self.salts = [np.uint64(int(rng.integers(1 << 62))) for _ in range(-(-self.steps // 32))]

    def keys(self, sequence: np.ndarray) -> np.ndarray:
        """The 32-bit key of the window that begins at each place of ``sequence``."""
        key = np.zeros(len(sequence), np.uint32)
        moved, bit = np.empty_like(key), np.empty_like(key)
        for j in range(self.steps - 1, -1, -1):
            if j == self.steps - 1 or j % 32 == 31:
                coins = (mix64(sequence ^ self.salts[j // 32]) >> np.uint64(16)).astype(np.uint32)
            # Where the coin says so, the window goes on from the next word: a choice without a branch.
            np.right_shift(coins, np.uint32(j % 32), out=bit)
            np.bitwise_and(bit, np.uint32(1), out=bit)
            np.negative(bit, out=bit)
            np.bitwise_xor(key[1:], key[:-1], out=moved[:-1])
            moved[-1:] = 0
            np.bitwise_and(moved, bit, out=moved)
            np.bitwise_xor(key, moved, out=key)
            if j in self.sampled:
                key += (mix64(sequence * self.sampled[j]) >> np.uint64(32)).astype(np.uint32)
        return key


@lru_cache(maxsize=64)
def repetitions(bits: int, edits: float, sampled: int, recall: float, trials: int = 300) -> int:
    """How many walks find a share of ``recall`` of the items of every length with ``bits`` bits, at all edits allowed for it.

    Counted on random items and edits, with the walks that an index makes. Items of 64 words and more have so many windows
    that the number for 32 to 63 words holds for them.
    """
    bits = min(bits, 6)
    size = WINDOWS[bits > 4]
    rng = np.random.default_rng([bits, trials])
    most = 0
    for n in range(max(LEAST_WORDS, 1 << (bits - 1)), 1 << bits):
        own, text = rng.integers(1, 1 << 62, (trials, n), dtype=np.uint64), []
        for words in own.tolist():
            for kind in rng.integers(3, size=int(n * edits)).tolist():  # replace, insert, delete
                at = int(rng.integers(len(words) + (kind == 1)))
                words[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
            text.append(words)
        gap = rng.integers(1, 1 << 62, (trials, 3 * size), dtype=np.uint64)
        rows = np.repeat(np.arange(trials), [len(t) + 3 * size for t in text])
        long = np.concatenate([np.concatenate([np.array(t, np.uint64), g]) for t, g in zip(text, gap, strict=True)])
        found, turn = np.zeros(trials, bool), 0
        while found.mean() < recall and turn < MOST_WALKS:
            walk = Walk(size, turn, sampled)
            mine = walk.keys(np.concatenate([own, np.zeros((trials, walk.steps), np.uint64)], axis=1).ravel()).reshape(trials, -1)[:, : n - size + 1]
            place = np.repeat(np.arange(trials), mine.shape[1])
            both = np.intersect1d(mine.ravel() | place.astype(np.uint64) << np.uint64(32), walk.keys(long) | rows.astype(np.uint64) << np.uint64(32))
            found[(both >> np.uint64(32)).astype(np.int64)] = True
            turn += 1
        most = max(most, turn)
    return most


def run_keys(sequence: np.ndarray, size: int) -> np.ndarray:
    """The 32-bit key of the ``size`` words that begin at each place of ``sequence``."""
    key = np.zeros(max(0, len(sequence) - size + 1), np.uint64)
    for j in range(size):
        key = (key + sequence[j : j + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(key) >> np.uint64(32)).astype(np.uint32)


class Table:
    """Keys of places of items, in order, and a bit map of them: 64 to 128 bits a key. Keys that more than ``most_items`` items share lead to none of them."""

    def __init__(self, keys: list[np.ndarray], item: list[int], offset: list[np.ndarray], most_items: int | None = None):
        own = np.concatenate(keys)
        items = np.repeat(np.array(item, np.int32), [len(k) for k in keys])
        order = np.argsort(own, kind="stable")
        if most_items is not None:
            order = order[(sharing(own, items) <= most_items)[order]]
        self.keys, self.item = own[order], items[order]
        self.offset = np.concatenate(offset).astype(np.int32)[order]
        bits = np.zeros(1 << max(16, (64 * len(own)).bit_length()), bool)
        self.mask = np.uint32(len(bits) - 1)
        bits[self.keys & self.mask] = True
        self.seen = np.packbits(bits, bitorder="little")

    def met(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first, last) for each place of ``own`` with a key of the table: its entries from first to last."""
        low = own & self.mask
        at = np.flatnonzero(self.seen[low >> np.uint32(3)] >> (low & np.uint32(7)).astype(np.uint8) & np.uint8(1))
        first, last = np.searchsorted(self.keys, own[at], "left"), np.searchsorted(self.keys, own[at], "right")
        some = last > first
        return at[some], first[some], last[some]

    def candidates(self, place: np.ndarray, first: np.ndarray, last: np.ndarray, allowed: np.ndarray | None = None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, where the item would begin) for entries of ``allowed`` items, about ``most`` at a time."""
        kept = None
        if allowed is not None:
            kept = np.flatnonzero(allowed[self.item])
            first, last = np.searchsorted(kept, first), np.searchsorted(kept, last)
        many = last - first
        for row, end in slices(np.append(0, np.cumsum(many)), most):
            n = many[row:end]
            flat = np.repeat(first[row:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat = flat if kept is None else kept[flat]
            own = np.repeat(place[row:end], n)
            yield own, self.item[flat], own - self.offset[flat]


def sharing(keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For each key how many different items have it."""
    both = np.unique(keys.astype(np.uint64) << np.uint64(32) | items.astype(np.uint64))
    own, n = np.unique(both >> np.uint64(32), return_counts=True)
    return n[np.searchsorted(own, keys)]


#: A window or a piece that more items share tells none of them apart.
FEW = 16
#: With more candidates than these a text is first asked which items' words it has.
MANY = 1 << 12


def apart(counts: np.ndarray, size: int, many: int, most: int) -> list[int]:
    """Where the first ``many`` pieces of ``size`` words begin that don't overlap and that at most ``most`` items share."""
    out, free = [], 0
    for k in np.flatnonzero(counts <= most).tolist():
        if k >= free:
            out.append(k)
            free = k + size
            if len(out) == many:
                break
    return out


def rare_pieces(words: list[np.ndarray], many: list[int]) -> list[tuple[int, list[int]]]:
    """(size, where they begin) of as many pieces of each item as asked for, which don't overlap, those that fewest items share.

    Any such pieces do: each edit spoils one at most. Items made from one template are told apart by their own words.
    """
    out: list[tuple[int, int, list[int]] | None] = [None] * len(words)
    longest = [len(w) // m for w, m in zip(words, many, strict=True)]
    for size in sorted({max(1, n >> k) for n in longest for k in range(n.bit_length())}, reverse=True):
        open_ = [k for k in range(len(words)) if size <= longest[k] and (out[k] is None or out[k][0] > FEW)]
        if not open_:
            continue
        keys = [run_keys(words[k], size) for k in open_]
        cuts = np.cumsum([0, *map(len, keys)])
        shared = sharing(np.concatenate(keys), np.repeat(np.array(open_, np.int32), np.diff(cuts)))
        for k, a, b in zip(open_, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            most = FEW
            while most <= 4 * len(words) and (out[k] is None or most < out[k][0]):
                found = apart(shared[a:b], size, many[k], most)
                if len(found) == many[k]:
                    out[k] = most, size, found
                    break
                most *= 4
    return [(o[1], o[2]) for o in out]


class Index:
    """The keys of windows of a bounded block of benchmark items, and what confirms a candidate.

    Of the windows of a long item ``most_windows``, evenly spread, are enough for the target recall; its pieces, all of
    them, catch the rest.
    """

    def __init__(self, items: list[tuple[int, str]], edits: float = 0.2, recall: float = 0.95, sampled: int = 4, most_windows: int = 256):
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        sequence, rows = symbols(data, offsets)
        self.ids, self.words = [], []
        self.edits = edits
        self._places: dict[int, dict[int, list[int]]] = {}
        walks: dict[tuple[int, int], list[int]] = {}
        own_pieces: list[list[tuple[int, int]]] = []
        for k, (i, _) in enumerate(items):
            own = sequence[rows[k] : rows[k + 1]]
            n = len(own)
            if i is not None and n:
                bits = n.bit_length()
                most = int(n * edits) if n >= LEAST_WORDS else 0
                for turn in range(repetitions(min(bits, 6), edits, sampled, recall) if n >= LEAST_WORDS else 0):
                    walks.setdefault((WINDOWS[bits > 4], turn), []).append(len(self.ids))
                cuts = np.linspace(0, n, min(n, most + 1) + 1).astype(int).tolist()
                own_pieces.append(list(zip(cuts, cuts[1:])))
                self.ids.append(i)
                self.words.append(own)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.mosts = np.where(lengths < LEAST_WORDS, 0, (lengths * edits).astype(np.int64))
        self.bounds = np.append(0, np.cumsum(lengths))
        self.all_words = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.walks, self.pieces = [], []
        for (size, turn), members in sorted(walks.items()):
            walk = Walk(size, turn, sampled)
            places = [np.arange(0, n - size + 1, -(-(n - size + 1) // most_windows)) for n in lengths[members].tolist()]
            # All items in a row, zeros between them: a window ends before the next item begins.
            gap = np.zeros(walk.steps, np.uint64)
            begins = np.cumsum([0, *(len(self.words[k]) + walk.steps for k in members)])
            row = walk.keys(np.concatenate([x for k in members for x in (self.words[k], gap)]))
            keys = [row[begin + at] for begin, at in zip(begins[:-1].tolist(), places, strict=True)]
            self.walks.append((walk, Table(keys, members, places, FEW)))
        pieces = self._cut(own_pieces)
        for size, places in sorted(pieces.items()):
            keys = [run_keys(self.words[k][a : a + size], size) for k, a in places]
            self.pieces.append((size, Table(keys, [k for k, _ in places], [np.array([a]) for _, a in places])))

    def _cut(self, own: list[list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """(item, begin) of the pieces of each size: the even ones of an item, but where many items share one of these its rarest."""
        by_size: dict[int, list[tuple[int, int]]] = {}
        for k, cuts in enumerate(own):
            for a, b in cuts:
                by_size.setdefault(b - a, []).append((k, a))
        common: set[int] = set()
        for size, at in by_size.items():
            keys = np.concatenate([run_keys(self.words[k][a : a + size], size) for k, a in at])
            common |= {at[j][0] for j in np.flatnonzero(sharing(keys, np.array([k for k, _ in at], np.int32)) > FEW).tolist()}
        common = {k for k in common if len(self.words[k]) > len(own[k])}
        out = {size: [x for x in at if x[0] not in common] for size, at in by_size.items()}
        again = sorted(common)
        for k, (size, begins) in zip(again, rare_pieces([self.words[k] for k in again], [len(own[k]) for k in again]), strict=True):
            out.setdefault(size, []).extend((k, a) for a in begins)
        return {size: at for size, at in out.items() if at}

    def at_hand(self, text: np.ndarray) -> np.ndarray:
        """For each item whether ``text`` has so many of its words, anywhere, that it may be in it."""
        known = np.unique(text)
        at = np.minimum(np.searchsorted(known, self.all_words), len(known) - 1)
        held = np.append(0, np.cumsum(known[at] == self.all_words))[self.bounds]
        return np.diff(held) >= np.diff(self.bounds) - self.mosts

    def places(self, k: int) -> dict[int, list[int]]:
        """Where each word is in item ``k``; those of a few items asked for last are at hand."""
        if k not in self._places:
            if len(self._places) >= 64:
                self._places.clear()
            found: dict[int, list[int]] = {}
            for j, w in enumerate(self.words[k].tolist()):
                found.setdefault(w, []).append(j)
            self._places[k] = found
        return self._places[k]

    def distance(self, k: int, text: list[int]) -> int:
        """The least number of words to insert, delete or replace that turn item ``k`` into some part of ``text``.

        Where the allowed edits suffice it is that of the first part for which they do.
        """
        places, n, most, left = self.places(k), len(self.words[k]), int(self.mosts[k]), 0
        masks: dict[int, int] = {}
        ones, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score, best = ones, 0, n, n
        for w in text:
            if w not in masks:
                if len(masks) * n > 1 << 26:
                    masks.clear()
                bits = np.zeros(n, bool)
                bits[places.get(w, [])] = True
                masks[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            eq = masks[w]
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(horizontal | plus), plus & horizontal
            if up & top:
                score += 1
            if down & top:
                score -= 1
            up, down = up << 1, down << 1
            plus, minus = (down | ~(vertical | up)) & ones, up & vertical & ones
            if best <= most:
                left -= 1  # the part goes on for as many words at most
            elif score <= most:
                left = most
            best = min(best, score)
            if best <= most and left <= 0:
                break
        return best

    def _stretches(self, sequence: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, low, high, begin) of the stretches of texts to verify, by text, item and place: candidates that overlap are one."""
        met = [(t, *t.met(walk.keys(np.append(sequence, np.zeros(walk.steps, np.uint64)))[: len(sequence)])) for walk, t in self.walks]
        met += [(t, *t.met(run_keys(sequence, size))) for size, t in self.pieces]
        load = np.zeros(len(rows) - 1, np.int64)
        whose = [np.searchsorted(rows, place, "right") - 1 for _, place, _, _ in met]
        for text, (_, _, first, last) in zip(whose, met, strict=True):
            np.add.at(load, text, last - first)
        # Texts with few candidates together, each of the others by itself, for some items at a time.
        turns: list[tuple[int | None, np.ndarray | None]] = [(None, None)]
        for k in np.flatnonzero(load > MANY).tolist():
            held = np.flatnonzero(self.at_hand(sequence[rows[k] : rows[k + 1]]))
            groups = -(-int(load[k]) * len(held) // (len(self.words) << 21)) if len(held) else 0
            turns += [(k, items) for items in np.array_split(held, groups)] if groups else []
        for only, items in turns:
            allowed = None
            if items is not None:
                allowed = np.zeros(len(self.words), bool)
                allowed[items] = True
            found = []
            for text, (t, place, first, last) in zip(whose, met, strict=True):
                now = np.flatnonzero(load[text] <= MANY if only is None else text == only)
                for own, item, begins in t.candidates(place[now], first[now], last[now], allowed):
                    found.append(self._distinct(np.searchsorted(rows, own, "right") - 1, item, begins))
            if not found:
                continue
            text, item, begin = self._distinct(*(np.concatenate(c) for c in zip(*found, strict=True)))
            n, most = np.diff(self.bounds)[item], self.mosts[item]
            low, high = np.maximum(rows[text], begin - 2 * most - 1), np.minimum(rows[text + 1], begin + n + 2 * most + 1)
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
            at = np.flatnonzero(first)
            yield from zip(text[at].tolist(), item[at].tolist(), low[at].tolist(), high[np.append(at[1:], len(text)) - 1].tolist() if len(at) else [], begin[at].tolist(), strict=True)

    def _distinct(self, text: np.ndarray, item: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in order of text, item and place; of those that begin within an item's allowed edits one is enough."""
        order = np.lexsort((begins, item, text))
        text, item, begins = text[order], item[order], begins[order]
        near = begins // (self.mosts[item] + 1)
        first = np.ones(len(order), bool)
        first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (near[1:] != near[:-1])
        return text[first], item[first], begins[first]

    def leaks(self, data: np.ndarray, offsets: np.ndarray, any_item: bool = False):
        """(row, item_id, distance, n_words, start) for each item within its allowed edits of some part of a row; one of them for ``any_item``.

        distance and start are those of the first stretch of the row that holds the item.
        """
        for row, end in slices(offsets, 1 << 18):
            sequence, rows = symbols(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            found: dict[tuple[int, int], tuple[int, int]] = {}
            done: set[int] = set()
            for k, i, low, high, begin in self._stretches(sequence, rows):
                if (k, i) in found or k in done:
                    continue
                n, most = len(self.words[i]), int(self.mosts[i])
                step = 4 * (n + most) + 256
                for at in range(low, high, step):  # each part that can hold the item lies in one of these
                    text = sequence[at : min(high, at + step + n + most)].tolist()
                    if sum(map(self.places(i).__contains__, text)) < n - most:
                        continue  # an item with so few of its words here is further away
                    d = self.distance(i, text)
                    if d <= most:
                        found[k, i] = d, max(0, max(begin, at) - int(rows[k]))
                        if any_item:
                            done.add(k)
                        break
            for (k, i), (d, begin) in sorted(found.items()):
                yield row + k, self.ids[i], d, len(self.words[i]), begin


def blocks(items: DataFrame, edits: float, most_bytes: int = 1 << 22) -> tuple[int, Iterator[Index]]:
    """How many blocks ``items`` (item_id, text) take, and their indexes one after another, each of about ``most_bytes`` of text.

    That bounds what goes to the executors at once: an index has about 25 bytes for each key, and for each word of its items
    as many keys as there are walks (for a long item, for 256 of its words) and a fifth of one for pieces. A block is made
    when it is asked for.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    many = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    return many, (Index([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).orderBy("item_id", "text").collect()], edits) for k in range(many))


def leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, most_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start_word) for each row of ``docs`` and benchmark item that leaks into it.

    An item leaks if at most ``edits`` of its words must be inserted, deleted or replaced to turn it into some part of
    the text; distance is that number for the first stretch of the text that holds it, and start_word about where that begins. Whole texts, at every word. Null or
    empty texts hold no leak, null item_ids or texts and items without words name none; items
    under five words leak where all their words stand in a row; repeated rows, null doc_ids among them, are searched
    alike, and other columns are ignored. A benchmark of several blocks is searched block by block, and what each finds is
    written; one block is searched when the result is asked for.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many, indexes = blocks(items, edits, most_bytes)
    found = []
    for index in indexes:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in parts(batches, 1):
                hits = list(sent.value.leaks(*utf8(batch.column(1))))
                columns = list(zip(*hits, strict=True)) or [()] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64())], ["doc_id", "item_id", "distance", "n_words", "start_word"])

        own = texts.mapInArrow(run, "doc_id long, item_id long, distance int, n_words int, start_word long")
        if many > 1:
            own = written(own, "leaks")
            sent.destroy()
        found.append(own)
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, items: DataFrame, edits: float = 0.2, most_bytes: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` without a leak of any of ``items``, with all their columns.

    Rows are judged one by one: null or empty texts and texts without words stay, null doc_ids and repeated rows are rows
    like all others. Without items, or with items without words, all rows stay. After each block of a large benchmark the
    rows that are left are written.
    """
    column = docs.columns.index("text")
    many, indexes = blocks(items, edits, most_bytes)
    for index in indexes:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in parts(batches, column):
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in sent.value.leaks(*utf8(batch.column(column)), any_item=True)]] = False
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if many > 1:
            docs = written(docs, "clean")
            sent.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
