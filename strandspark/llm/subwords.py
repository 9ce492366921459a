"""Byte-level vocabularies, and texts cut into chunks that a byte-level tokenizer treats independently of each other."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .common import utf8

#: The characters with the Unicode property White_Space, which the pre-tokenizer's \s stands for.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The public pattern that splits text into pre-tokens before byte-level merges.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def place_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


class Vocabulary:
    """A byte-level BPE vocabulary file: ids of single bytes, merges by pair, bytes of each id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        ids, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        of = {c: b for b, c in enumerate(byte_characters())}
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.byte_ids = np.array([ids[c] for c in byte_characters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.into = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.seen = np.zeros(1 << 20, bool)  # by the high bits of a product: most pairs that are no merge need no search
        self.seen[place_of(self.keys)] = True
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(of[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(ends[-1])
        return self.bytes[at].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 a number, 3 white space, else 0."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for m in regex.finditer(rf"(\p{{L}}+)|(\p{{N}}+)|([{SPACE}]+)", points):
        out[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = m.lastindex
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, points): where the characters of UTF-8 bytes begin, and their code points."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[starts].astype(np.int32)
    long = np.flatnonzero(points >= 0xC0)
    if len(long):
        at = starts[long]
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        lead, b, c, d = padded[at], padded[at + 1] & 63, padded[at + 2] & 63, padded[at + 3] & 63
        points[long] = np.where(lead < 0xE0, (lead & 31) << 6 | b, np.where(lead < 0xF0, (lead & 15) << 12 | b << 6 | c, (lead & 7) << 18 | b << 12 | c << 6 | d))
    return starts, points


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, owners): where the pre-tokens of each row begin, in bytes, and how many there are before each row.

    The same as ``PRETOKEN`` finds in each row, for all rows at once: runs of letters, of numbers and of other characters, each
    with one space before it; of white space before other characters the last one is apart; contractions where a pre-token
    would begin with their apostrophe.
    """
    at, points = code_points(data)
    kind = _classes()[points]
    first = np.zeros(len(at) + 1, bool)  # of a row
    rows = np.searchsorted(at, offsets)
    first[rows] = True
    begin = first.copy()
    begin[1:-1] |= kind[1:] != kind[:-1]
    begin[:-2] |= (kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:-1]
    begin[1:-1] &= ~((points[:-1] == 32) & (kind[1:] != 3) & ~first[1:-1])
    mark = np.flatnonzero((points == 39) & begin[:-1])
    if len(mark):
        padded = np.append(points, np.zeros(2, np.int32))
        inside = ~first[mark + 1]
        x, y = padded[mark + 1], padded[mark + 2]
        one = inside & np.isin(x, [ord(c) for c in "stmd"])
        two = inside & ~first[np.minimum(mark + 2, len(at))] & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        begin[mark[one | two] + 1] = False
        begin[mark[one] + 2] = True
        begin[np.minimum(mark[two] + 3, len(at))] = True
    found = np.flatnonzero(begin[:-1])
    return at[found], np.searchsorted(found, rows)


def distinct(data: np.ndarray, starts: np.ndarray, ends_at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which): the distinct pieces among those that begin at ``starts``, and which one each piece is."""
    offsets = np.append(starts, ends_at).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = whole.dictionary_encode()
    own, own_offsets = utf8(coded.dictionary)
    return own, own_offsets, coded.indices.to_numpy(zero_copy_only=False)


#: Bytes that surely are no white space, as the first and as the last byte of a character.
INK_FIRST = np.ones(256, bool)
INK_FIRST[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = False
INK_LAST = np.ones(256, bool)
INK_LAST[[*range(9, 14), 32, 0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


class Chunked:
    """Token ids of whole texts, put together from chunks that repeat.

    A space after a character that isn't white space, or before one, begins a pre-token. Texts are cut at these spaces
    alone, so the ids of the chunks in a row are those of the text. ``encode`` gets the bytes and offsets of distinct chunks
    and gives all their ids in a row and how many each has. Nothing is remembered between calls, so what is in memory
    follows from the bytes of one call. Bytes that aren't UTF-8 count as U+FFFD.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], added: dict[str, int]):
        self.encode, self.added = encode, {t.encode(): i for t, i in added.items()}

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: at rows, at spaces as above, before and after the strings of added tokens."""
        edges = [offsets[:-1][np.diff(offsets) > 0]]
        raw = None
        for token in self.added:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(token)
            while at >= 0:
                if offsets[np.searchsorted(offsets, at, "right")] >= at + len(token):
                    edges.append(np.array([at, at + len(token)]))
                    at = raw.find(token, at + len(token))
                else:  # across two rows
                    at = raw.find(token, at + 1)
        edges = np.unique(np.concatenate(edges))
        edges = edges[edges < len(data)]
        space = np.flatnonzero(data == 32)
        cut = np.zeros(len(data) + 1, bool)
        cut[edges] = True
        cut[len(data)] = True
        after = ~cut[space + 1] & INK_FIRST[data[np.minimum(space + 1, len(data) - 1)]]
        before = (space > 0) & ~cut[space] & INK_LAST[data[space - 1]]
        cut[space[after | before]] = True
        return np.flatnonzero(cut[:-1])

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, which, rows): the ids of distinct chunks, how many each has, the chunks in a row, and where rows begin in these."""
        data, offsets = valid(data, offsets)
        starts = self._cuts(data, offsets)
        own, own_offsets, which = distinct(data, starts, len(data))
        ids, lengths = self.encode(own, own_offsets)
        if self.added:
            size = np.diff(own_offsets)
            for token, i in self.added.items():
                for k in np.flatnonzero(size == len(token)):
                    if own[own_offsets[k] : own_offsets[k + 1]].tobytes() == token:
                        ends = np.cumsum(lengths)
                        ids = np.concatenate([ids[: ends[k] - lengths[k]], np.array([i], ids.dtype), ids[ends[k] :]])
                        lengths[k] = 1
        return ids, lengths, which, np.searchsorted(starts, offsets)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all rows in a row, as little-endian unsigned 32-bit integers, and where each row's begin."""
        ids, lengths, which, rows = self.coded(data, offsets)
        many = lengths[which]
        ends = np.append(0, np.cumsum(many))
        at = np.repeat((np.cumsum(lengths) - lengths)[which] - ends[:-1], many)
        at += np.arange(ends[-1])
        return ids.astype("<u4")[at], ends[rows]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where ``encode`` gives one number a chunk: its sum over each row."""
        numbers, _, which, rows = self.coded(data, offsets)
        return np.diff(np.append(0, np.cumsum(numbers[which]))[rows])


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, with U+FFFD for bytes that aren't UTF-8."""
    try:
        data.tobytes().decode()
        if not (data[offsets[:-1][offsets[:-1] < len(data)]] & 0xC0 == 0x80).any():
            return data, offsets
    except UnicodeDecodeError:
        pass
    mended = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(mended), np.uint8), np.cumsum([0, *map(len, mended)])
