"""Encoding by a sentencepiece BPE model with spans of the original bytes, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, slices, table

#: The model that the registered query encodes with; any path that all machines can read will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text taken in at a time, characters encoded at a time, and what a task remembers: so many segments, of so many
#: characters at most.
CHUNK, STRETCH, SEGMENTS, LONGEST = 2 << 20, 1 << 18, 250_000, 64
#: Fixed values of the model file: what stands for a space, kinds of pieces, and the character of an invalid byte.
MARK, NORMAL, UNKNOWN, CONTROL, BYTE, INVALID = "▁", 1, 2, 3, 6, "�"
BREAK, _NEVER = "\0", float("-inf")  # what parts segments, and the score of what is no piece


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields; messages and strings are bytes, floats four bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def compiled_map(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: a double array of 32-bit units, then texts that end with NUL.

    A unit holds its label (the low byte), whether a value hangs below it (bit 8), and the offset of its children (bits
    10 and up, times 256 if bit 9 is set). All keys are read level by level.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64), blob[4 + size :]
    below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    nodes, keys, found = np.array([below(units[0])]), [b""], {}
    while len(nodes):
        children = nodes[:, None] ^ np.arange(256)[None, :]
        unit = units[np.minimum(children, len(units) - 1)]
        is_child = (children < len(units)) & ((unit & (1 << 31 | 255)) == np.arange(256)[None, :])
        is_child[:, 0] = False  # the value's place
        parent, label = np.nonzero(is_child)
        unit = unit[parent, label]
        nodes = children[parent, label] ^ below(unit)
        keys = [keys[p] + bytes([c]) for p, c in zip(parent.tolist(), label.tolist())]
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            start = int(units[nodes[k]] & 0x7FFFFFFF)
            found[keys[k].decode()] = texts[start : texts.index(b"\0", start)].decode()
    return found


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind
    replaced: dict[str, str]  # the character map
    prefix: bool  # whether a space is put before each text
    squeeze: bool  # whether runs of spaces become one, and spaces at the ends go


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """A BPE model with byte fallback, as sentencepiece writes it; any other is an error."""
    with open(path, "rb") as file:
        return parse(file.read())


def parse(raw: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), float(np.frombuffer(piece.get(2, bytes(4)), np.float32)[0]), piece.get(3, NORMAL)))
        elif number in (2, 3):
            (trainer if number == 2 else normalizer).update(fields(value))
        elif number == 5 and dict(fields(value)).get(2):
            raise ValueError("a model that maps decoded texts isn't supported")
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not normalizer.get(5, 1) or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
        raise ValueError("not a BPE model with byte fallback and plain pieces")
    return Model(tuple(pieces), compiled_map(normalizer.get(2, b"")), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def characters(raw: bytes) -> tuple[str, np.ndarray]:
    """A text and the byte at which each of its characters begins, and the end; an invalid byte is a character by itself."""
    text, sizes, at = [], [], 0
    while at < len(raw) or not text:
        try:
            part, bad = raw[at:].decode(), 0
        except UnicodeDecodeError as error:
            part, bad = raw[at : at + error.start].decode(), 1
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        sizes.append(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        at += int(sizes[-1].sum()) + bad
        text.append(part + INVALID * bad)
        sizes.append(np.ones(bad, np.int64))
    return "".join(text), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


class Normalizer:
    """Longest-prefix normalisation, with the original byte from which each normalised byte comes."""

    def __init__(self, model: Model):
        self.model, self.replaced = model, model.replaced
        if any("  " in v for v in self.replaced.values()):
            raise ValueError("a replacement with two spaces in a row isn't supported")
        self.longest = max(map(len, self.replaced), default=0)
        listed = lambda some: "[" + "".join(map(re.escape, sorted(some))) + "]"
        single, long = {k for k in self.replaced if len(k) == 1}, [k for k in self.replaced if len(k) > 1]
        ways = ([listed(single)] if single else []) + ([f"{listed({k[0] for k in long})}(?={listed({k[1] for k in long})})"] if long else [])
        #: Where a key may begin; every other character stays.
        self.begins = re.compile("|".join(ways)) if ways else None

    def mapped(self, text: str, at: np.ndarray) -> tuple[str, np.ndarray]:
        """The text with the longest key at each place replaced, and where each character comes from, and the end."""
        if self.begins is None:
            return text, at
        parts, origin, done = [], [], 0
        for match in self.begins.finditer(text):
            place = match.start()
            if place < done:
                continue
            key = next((k for n in range(self.longest, 0, -1) if (k := text[place : place + n]) in self.replaced), None)
            if key is not None:
                new = self.replaced[key]
                parts += [text[done:place], new]
                origin += [at[done:place], np.full(len(new), at[place])]
                done = place + len(key)
        return "".join([*parts, text[done:]]), np.concatenate([*origin, at[done:]])

    def __call__(self, raw: bytes) -> tuple[str, np.ndarray]:
        """(normalised text with marks for spaces, the original byte of each of its bytes and the end)."""
        text, at = self.mapped(*characters(raw))
        if self.model.squeeze:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            space = codes == 32
            real = np.flatnonzero(~space & (codes != ord(MARK)))  # a mark at the end goes like a space
            if not len(real):
                return "", np.zeros(1, np.int64)
            keep = ~(space & np.append(True, space[:-1]))
            keep[real[-1] + 1 :] = False
            text, at = codes[keep].tobytes().decode("utf-32-le"), np.append(at[:-1][keep], at[real[-1] + 1])
        if not text:
            return "", np.zeros(1, np.int64)
        if self.model.prefix:
            text, at = " " + text, np.append(at[:1], at)
        text = text.replace(" ", MARK)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return text, np.append(np.repeat(at[:-1], 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)), at[-1])


class Merges:
    """The merges of many words at once: of each word the best pair a round, in arrays over all words."""

    def __init__(self, ids: dict[str, int], score: dict[str, float]):
        single = sorted((ord(p), k) for p, k in ids.items() if len(p) == 1)
        self.codes, self.single = np.array([c for c, _ in single], np.int64), np.array([k for _, k in single], np.int64)
        self.width = max(ids.values(), default=0) + 1
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}  # the best score first
        self.never = len(rank)
        pairs = {ids[p[:k]] * self.width + ids[p[k:]]: (rank[score[p]], n) for p, n in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        #: A hash table of pairs: the key, the rank and the piece of each slot; a pair is in one of the `reach` slots from its own.
        self.bits = len(pairs).bit_length() + 2
        keys = np.array(list(pairs), np.int64)
        slot, free, left, self.reach = np.full(1 << self.bits, -1, np.int64), np.ones(1 << self.bits, bool), np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + self.reach) & ((1 << self.bits) - 1)
            _, first = np.unique(at, return_index=True)
            first = first[free[at[first]]]
            slot[at[first]], free[at[first]] = left[first], False
            left, self.reach = np.delete(left, first), self.reach + 1
        values = np.array([*pairs.values(), (self.never, -1)], np.int64)
        self.key = np.append(keys, -1)[slot]
        self.rank, self.piece = values[slot, 0], values[slot, 1]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of pieces, `never` where they make none."""
        keys = left * self.width + right
        at = self._slot(keys)
        rank, piece, open_ = np.full(len(keys), self.never), np.full(len(keys), -1), np.arange(len(keys))
        for _ in range(self.reach):
            there = self.key[at]
            hit = there == keys[open_]
            rank[open_[hit]], piece[open_[hit]] = self.rank[at[hit]], self.piece[at[hit]]
            go = ~hit & (there >= 0)  # a slot that nothing took ends the search
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, piece

    def all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, how many each word has, able): words with a character in no piece are left out."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        able = np.logical_and.reduceat(known, np.cumsum(size) - size)
        symbol = self.single[at][np.repeat(able, size)]
        word, size = np.flatnonzero(able), size[able]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(symbol), self.never), np.full(len(symbol), -1)
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(size) - 1] = True
        inner = np.flatnonzero(~last)
        rank[inner], piece[inner] = self.found(symbol[inner], symbol[inner + 1])
        while len(word):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, begin)
            over = best == self.never
            if over.any():
                gone = np.repeat(over, size)
                done.append((word[over], size[over], symbol[gone]))
                symbol, rank, piece, last = symbol[~gone], rank[~gone], piece[~gone], last[~gone]
                word, size, best = word[~over], size[~over], best[~over]
                if not len(word):
                    break
                begin = np.cumsum(size) - size
            equal = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(begin, equal, side="right") - 1
            left = equal[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
            symbol[left], last[left] = piece[left], last[left + 1]
            keep = np.ones(len(symbol), bool)
            keep[left + 1] = False
            left = left - np.arange(len(left))  # one symbol has gone from each word before
            symbol, rank, piece, last = symbol[keep], rank[keep], piece[keep], last[keep]
            size = size - 1
            before = left[left > 0] - 1
            changed = np.concatenate([left, before[~last[before]]])
            rank[changed], piece[changed] = self.never, -1
            changed = changed[~last[changed]]
            rank[changed], piece[changed] = self.found(symbol[changed], symbol[changed + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64), able
        words_, sizes, symbols = map(np.concatenate, zip(*done))
        order = np.argsort(words_)
        begin = (np.cumsum(sizes) - sizes)[order]
        count = sizes[order]
        ids = symbols[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        whole = np.zeros(len(words), np.int64)
        whole[words_[order]] = count
        return ids, whole, able


class Encoder:
    """Ids of texts. Segments, between which nothing can merge, are merged once and remembered, SEGMENTS of them at most."""

    def __init__(self, model: Model):
        self.model, self.normalize = model, Normalizer(model)
        self.id = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.score = {p: score for p, score, kind in model.pieces if kind == NORMAL}
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        #: Bytes of each id's piece in the normalised text, and in one where each mark was a space; the byte of a byte's id.
        self.size = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(p.encode()) for p, _, kind in model.pieces], np.int64)
        self.source = self.size - [2 * p.count(MARK) if kind == NORMAL else 0 for p, _, kind in model.pieces]
        self.byte_of = np.full(len(model.pieces), -1, np.int64)
        self.byte_of[list(self.byte.values())] = list(self.byte)
        self.end = next((k for k, (p, _, kind) in enumerate(model.pieces) if kind == CONTROL and p == "</s>"), None)
        joined = [p for p in self.id if len(p) > 1]
        alone = "".join(c for c in map(chr, range(32)) if not any(c in p for p in joined))  # in no merge
        #: No piece goes on with a mark after another character, so no merge joins what stands on both sides of one.
        self.cut = not any(MARK in p.lstrip(MARK) for p in joined)
        self.segment = re.compile(f"[{re.escape(alone)}]|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.border = re.compile(f"(?<=[^{MARK}]){MARK}")
        self.plain = self.cut and "\n" in alone and model.prefix and not model.squeeze and not model.replaced
        self.merges = Merges(self.id, self.score)
        self.number: dict[str, int] = {}
        self.flat, self.begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)  # ids of all segments, and where each's begin

    def numbered(self, segments: list[str]) -> np.ndarray:
        """The numbers of segments; new ones are merged. forget() drops those that are too many or too long to keep."""
        known = self.number
        new = [x for x in dict.fromkeys(segments) if x not in known]
        short = [x for x in new if 0 < len(x) <= LONGEST]
        if short:
            ids, count, able = self.merges.all(short)
            if not able.all():  # characters in no piece
                short, count, rest = *([x for x, a in zip(short, able.tolist()) if a], count[able]), [x for x, a in zip(short, able.tolist()) if not a]
            else:
                rest = []
            self._keep(short, ids, count)
            for x in rest:
                self._keep([x], self.ids_of(self.merged_short(x)))
        for x in new:
            if not 0 < len(x) <= LONGEST:
                self._keep([x], self.ids_of(self.merged(x)))
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def _keep(self, segments: list[str], ids: np.ndarray | list[int], count: np.ndarray | None = None) -> None:
        n, at = len(self.number), int(self.begin[len(self.number)])
        while n + len(segments) + 1 > len(self.begin):
            self.begin = np.append(self.begin, np.zeros_like(self.begin))
        while at + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[at : at + len(ids)] = ids
        self.begin[n + 1 : n + len(segments) + 1] = at + (len(ids) if count is None else np.cumsum(count))
        self.number.update(zip(segments, range(n, n + len(segments))))

    def forget(self) -> None:
        """Keep the segments that came first, which are the frequent ones, and no long ones."""
        known = self.number
        while known and (len(known) > SEGMENTS or len(next(reversed(known))) > LONGEST):
            known.popitem()

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered segments one after another, and how many each has."""
        begin, count = self.begin[numbers], self.begin[numbers + 1] - self.begin[numbers]
        return self.flat[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())], count

    def ids_of(self, symbols: list[str]) -> list[int]:
        """A piece's id, or those of the bytes of a character in no piece."""
        known = self.id
        return [known[s] for s in symbols] if all(s in known for s in symbols) else list(chain.from_iterable([known[s]] if s in known else [self.byte[b] for b in s.encode()] for s in symbols))

    def merged_short(self, text: str) -> list[str]:
        """merged(), in less time where there are few symbols to look through."""
        score, symbols = self.score.get, list(text)
        found = [score(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while found:
            best = max(found)
            if best == _NEVER:
                break
            k = found.index(best)
            del found[k]
            symbols[k] += symbols.pop(k + 1)
            if k < len(found):
                found[k] = score(symbols[k] + symbols[k + 1], _NEVER)
            if k:
                found[k - 1] = score(symbols[k - 1] + symbols[k], _NEVER)
        return symbols

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours whose joint piece scores best, the leftmost of several, until no two make a piece."""
        score = self.score
        symbols, before, after = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap = [(-score[p], k, p) for k in range(len(text) - 1) if (p := text[k : k + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= len(symbols) or symbols[left] + symbols[right] != piece:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = piece, None
            after[left] = beyond = after[right]
            if beyond < len(symbols):
                before[beyond] = left
                if (p := piece + symbols[beyond]) in score:
                    heapq.heappush(heap, (-score[p], left, p))
            if (back := before[left]) >= 0 and (p := symbols[back] + piece) in score:
                heapq.heappush(heap, (-score[p], back, p))
        return [s for s in symbols if s is not None]

    def stretches(self, text: str) -> Iterator[str]:
        """The text in parts of about STRETCH characters between which nothing can merge."""
        start = 0
        while self.cut and (border := self.border.search(text, start + STRETCH)):
            yield text[start : border.start()]
            start = border.start()
        yield text[start:] if start else text

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids without an end, starts, ends): each piece's span of the original bytes."""
        text, origin = self.normalize(raw)
        parts = []
        for stretch in self.stretches(text):
            parts.append(self.ids(self.numbered(self.segment.findall(stretch) if self.cut else [stretch]))[0])
            self.forget()
        ids = np.concatenate(parts)
        edges = np.concatenate([[0], np.cumsum(self.size[ids])])
        return ids, origin[edges[:-1]], origin[edges[1:]]

    def encode_all(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text of a column without nulls.

        Where the model's character map is empty, texts in which no space is followed by another, and that have neither
        marks of their own nor BREAK, are cut into segments all at once, and the spans are what each piece stands for: a
        space for a mark, but for the first.
        """
        try:
            column.validate(full=True)
            valid = self.plain
        except pa.ArrowInvalid:  # not UTF-8
            valid = False
        if not valid:
            return [self.encode(raw) for raw in blobs(column)]
        special = pc.or_(pc.equal(pc.binary_length(column), 0), pc.starts_with(column, " "))
        for odd in ("  ", MARK, BREAK):
            special = pc.or_(special, pc.match_substring(column, odd))
        odd = special.to_numpy(zero_copy_only=False)
        texts = column.filter(pc.invert(special))
        done = iter(self._plainly(texts) if len(texts) else [])
        return [self.encode(raw) if o else next(done) for o, raw in zip(odd.tolist(), blobs(column) if odd.any() else [b""] * len(column))]

    def _plainly(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", BREAK + MARK), "\n", f"{BREAK}\n{BREAK}")
        parts = pc.split_pattern(pc.binary_join_element_wise(MARK, marked, ""), BREAK)
        different = parts.flatten().dictionary_encode()
        numbers = self.numbered(different.dictionary.to_pylist())[different.indices.to_numpy(zero_copy_only=False)]
        ids, count = self.ids(numbers)
        self.forget()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(count)])[offsets - offsets[0]]  # each text's ids
        size = self.source[ids]
        size[edges[:-1]] -= 1  # the first mark is no space of the text
        ends = np.cumsum(size)
        starts = ends - size
        byte = self.byte_of[ids]
        going_on = (byte & 0xC0) == 0x80
        going_on[byte < 0] = False
        if going_on.any():  # all bytes of a character begin with it, and all but the last end there
            begun = np.maximum.accumulate(np.where(going_on, 0, np.arange(len(ids))))
            starts = starts[begun]
            ends = np.where(np.append(going_on[1:], False), starts, ends)
        base = starts[edges[:-1]].repeat(np.diff(edges))
        starts, ends = starts - base, ends - base
        return [(ids[a:b], starts[a:b], ends[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def valid(raw: bytes) -> bytes:
    """UTF-8, with INVALID for each byte that is in no character."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return characters(raw)[0].encode()
    return raw


class Decoder:
    """Texts of ids, as the model writes them."""

    def __init__(self, model: Model):
        self.model = model
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.control = [k for k, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL]
        self.spaced = [kind == NORMAL and p.startswith(MARK) for p, _, kind in model.pieces]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text: the space that was put before it goes, and a byte of no character is INVALID."""
        parts = list(map(self.raw.__getitem__, ids))
        if self.model.prefix or self.model.squeeze:
            for k, part in enumerate(parts):
                if self.spaced[ids[k]]:
                    parts[k] = part = part[1:]
                    if not self.model.squeeze:
                        break
                if part:
                    break
        if any(c in ids[:-1] for c in self.control):  # bytes on both sides of one make no character together
            at = [-1, *(k for k, i in enumerate(ids) if i in self.control), len(ids)]
            return b"".join(valid(b"".join(parts[i + 1 : j])) for i, j in zip(at, at[1:]))
        return valid(b"".join(parts))


_held: dict[str, tuple[Encoder, Decoder]] = {}


def coder(path: str) -> tuple[Encoder, Decoder]:
    """The Encoder and Decoder that this Python process keeps for a model, with the segments of its earlier tasks."""
    if path not in _held:
        model = load(path)
        _held[path] = Encoder(model), Decoder(model)
    return _held[path]


def lists(values: list[np.ndarray], each: int, kind: pa.DataType) -> pa.Array:
    """Lists, each of `each` arrays one after another."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])[::each].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32) if values else [], kind))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, ids, starts, ends) of every row's whole text, the end id last.

    ids are exactly sentencepiece's. The text is normalised by the longest keys of the model's character map, which
    records the original byte of each normalised one; segments between which no merge is possible are encoded once a
    Python process and remembered, SEGMENTS of them at most. starts and ends are each piece's span of the text's bytes:
    of a character in no piece, which is a piece for each of its bytes, the last has the span and the others are empty;
    the end id's is empty and at the end. A null text is empty; repeated rows repeat; invalid UTF-8 is INVALID a byte;
    an empty table gives no rows; other columns are ignored. No row is moved.
    """
    load(model)  # an error at once, and not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(model)[0]
        last = np.array([encoder.end], np.int32)
        for batch in slices(batches, "text", CHUNK):
            texts = pc.fill_null(batch.column("text"), "")
            found = encoder.encode_all(texts)
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [lists([x for ids, _, _ in found for x in (ids, last)], 2, pa.int32())]
            columns += [lists([x for f, n in zip(found, size) for x in (f[k], np.array([n]))], 2, pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), *columns], names=["doc_id", "n_bytes", "ids", "starts", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL, digests: bool = False) -> DataFrame:
    """(doc_id, text) of rows(doc_id, ids), as sentencepiece decodes them; null ids are none.

    With `digests`, of encode_documents()'s rows: (doc_id, n_tokens, ids_sha256, decoded_sha256, n_spanned) instead, the
    digests of the decimal ids joined by spaces and of the decoded text, and the bytes that the pieces' spans cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(model)[1]
        decimal = [str(k) for k in range(len(decoder.raw))]
        hexed = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            rows = []
            for n, ids in enumerate(batch.column("ids")):  # a row's ids at a time: as Python's numbers they are many times as large
                ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                text = decoder.decode(ids)
                if digests:
                    starts, ends = (batch.column(c)[n].values.to_numpy(zero_copy_only=False).sum(dtype=np.int64) for c in ("starts", "ends"))
                    rows.append((len(ids), hexed(" ".join(map(decimal.__getitem__, ids)).encode()), hexed(text), int(ends - starts)))
                else:
                    rows.append((text.decode(),))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64()) if digests else (pa.string(),)
            arrays = [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *(["n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"] if digests else ["text"])])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long" if digests else "text string"))


def op13_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and of the texts decoded from them, of all documents; n_spanned is the bytes that pieces cover.

    Nulls, ties, repeats and empty tables as in encode_documents().
    """
    return decode_documents(encode_documents(table(spark, sf_dir, "documents")), digests=True)
