"""Benchmark passages in texts: latent semantic retrieval and a join on rare words, then alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, drop_rows, slices, stage, table, text_hash
from .licenses import _FOLD

#: Words of benchmark items that one latent space serves, and that one scan of the texts serves; an item that has more is alone.
BLOCK, SCAN = 1 << 17, 1 << 21
#: Bytes of text, item words of texts, and bytes of a table of halves' words, that are taken into numpy at a time.
CHUNK, WORDS, TABLE = 1 << 20, 1 << 15, 1 << 25
#: Rank of the latent space, and further directions of the random sketch that it is drawn from.
RANK, OVERSAMPLE = 48, 16
#: Words of the smallest half window; windows double up to the longest item's length. Words of a passage of the latent space.
STEP, PASSAGE = 8, 32
#: Cosine of a candidate; share of an item's words in common order that is a copy; the same for a paraphrase, whose
#: answer, the last ANSWER of the item's words, must be there at a copy's share.
COSINE, COPY, PARAPHRASE, ANSWER = 0.5, 0.8, 0.5, 0.25


def split(text: bytes) -> list[bytes]:
    """Words: runs of ASCII letters (lower-cased), digits and other characters outside ASCII."""
    return text.translate(_FOLD).split()


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with a's positions as the bits of a number."""
    at: dict = {}
    for k, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        if (m := at.get(word)) is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def verdict(item: list, region: list) -> tuple[float, bool]:
    """Share of the item's words in common order with a region, and whether that is a leak.

    Words that the region has at all bound that share from above, and settle most regions.
    """
    share = sum(map(set(region).__contains__, item)) / len(item)
    if share < PARAPHRASE:
        return share, False
    share = subsequence(item, region) / len(item)
    if share < PARAPHRASE:
        return share, False
    answer = item[-max(1, round(len(item) * ANSWER)) :]
    return share, share >= COPY or subsequence(answer, region) >= COPY * len(answer)


def _least(share: float, size: int) -> int:
    """The smallest number of `size` words that is a share of them, as verdict() compares."""
    return next(c for c in range(size + 1) if c / size >= share and c >= share * size)


def rare_words(item: list, seen) -> set:
    """Words of an item of which every region that verdict() calls a leak has one (prefix filter), by the documents each stands in.

    A copy lacks so few of the item's words that it has one of the rarest of them; a paraphrase likewise has one of
    the answer's, and of the rarest of PARAPHRASE of the item's, of which the set in fewer documents is taken.
    """

    def prefix(part: list, share: float) -> list:
        return sorted(part, key=lambda w: (seen[w], w))[: len(part) - _least(share, len(part)) + 1]

    answer = item[-max(1, round(len(item) * ANSWER)) :]
    either = [set(prefix(answer, COPY)), set(prefix(item, PARAPHRASE))]
    return min(either, key=lambda ws: sum(seen[w] for w in ws)).union(prefix(item, COPY))


def possible(item: list, present: set) -> bool:
    """Whether a region of these words can be a leak; no leak is denied."""
    common = [*map(present.__contains__, item)]
    n = sum(common)
    answer = common[-max(1, round(len(item) * ANSWER)) :]
    return n >= PARAPHRASE * len(item) - 1e-9 and (n >= COPY * len(item) - 1e-9 or sum(answer) >= COPY * len(answer) - 1e-9)


def _width(item: list) -> int:
    """Words of the windows that are held against an item."""
    return max(2 * STEP, 1 << (len(item) - 1).bit_length())


def encode(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, h, ids, at) of every row of docs: the numbers of its words that are known, and their places among its words.

    The only scan of the texts; whatever follows reads these numbers. A long text is split a piece at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most the words of one scan's items
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value)}
        for batch in slices(batches, "text", CHUNK):
            ids, places, sizes = [], [], []
            for text in blobs(batch.column("text")):
                folded, start, n, found = text.translate(_FOLD), 0, 0, 0
                while start < len(folded):
                    stop = folded.find(b" ", start + CHUNK)
                    words = folded[start : stop if stop >= 0 else None].split()
                    numbers = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                    at = np.flatnonzero(numbers >= 0)
                    ids.append(numbers[at])
                    places.append((at + n).astype(np.int32))
                    n, found, start = n + len(words), found + len(at), stop if stop >= 0 else len(folded)
                sizes.append(found)
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, np.int32)]))) for x in (ids, places)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *lists], names=["doc_id", "h", "ids", "at"])

    return docs.mapInArrow(run, f"doc_id {kind}, h long, ids array<int>, at array<int>")


@dataclass
class Chunk:
    """Known words of some texts, or of a part of a long one, at places that no two texts share.

    A part begins at `base`, a multiple of the padding, which is the word `shift` of row `row`; ids and place go by place.
    """

    ids: np.ndarray
    place: np.ndarray
    row: np.ndarray
    base: np.ndarray
    shift: np.ndarray

    def part(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1


def chunks(batch: pa.RecordBatch, local: np.ndarray, pad: int, overlap: int = 0) -> Iterator[Chunk]:
    """encode()'s rows with their words renumbered by `local` (those at -1 are left out), about WORDS of them at a time.

    Parts of a text of more words begin at multiples of `pad` and reach `overlap` words, such a multiple, into their neighbours.
    """
    ids, places = (batch.column(c).flatten().to_numpy() for c in ("ids", "at"))
    ends = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
    span = -(-WORDS // pad) * pad
    parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> Chunk:
        lengths = [int(at[-1]) + 1 - shift for _, shift, _, at in parts]
        base = np.cumsum([0, *(-(-n // pad) * pad for n in lengths)])[:-1]
        place = [at + (b - shift) for b, (_, shift, _, at) in zip(base.tolist(), parts)]
        return Chunk(np.concatenate([p[2] for p in parts]), np.concatenate(place), np.array([p[0] for p in parts]), base, np.array([p[1] for p in parts]))

    for row, (start, stop) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
        mine = local[ids[start:stop]]
        kept = mine >= 0
        mine, at = mine[kept], places[start:stop][kept].astype(np.int64)
        if not len(mine):
            continue
        cuts = range(0, int(at[-1]) + 1, span) if len(mine) > WORDS else (0,)
        for cut in cuts:
            low, high = (max(0, cut - overlap), cut + span + overlap) if len(cuts) > 1 else (0, int(at[-1]) + 1)
            i, j = np.searchsorted(at, [low, high])
            if j > i:
                parts.append((row, low, mine[i:j], at[i:j]))
                size += int(j - i)
            if size > WORDS:
                yield close()
                parts, size = [], 0
    if parts:
        yield close()


def _sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows over runs of equal, ascending groups, and those groups."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, int)
    return (np.add.reduceat(values, starts, axis=0) if len(starts) else values), groups[starts]


def _row_sums(table: np.ndarray, rows: np.ndarray, scale: np.ndarray | None, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_sums() of table[rows] (times scale), for short runs: all groups' first rows at once, then their second ones, and so on."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, int)
    lengths = np.diff(np.append(starts, len(groups)))
    out = np.zeros((len(starts), table.shape[1]), table.dtype)
    longest = np.argsort(-lengths, kind="stable")
    for k in range(int(lengths.max(initial=0))):
        longest = longest[lengths[longest] > k]
        at = starts[longest] + k
        out[longest] += table[rows[at]] if scale is None else table[rows[at]] * scale[at, None]
    return out, groups[starts]


def document_frequencies(coded: DataFrame, size: int) -> np.ndarray:
    """In how many rows of encode() each of `size` words stands; all rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            pairs = np.sort(row * size + ids)
            seen += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] % size, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["w", "n"])

    found = coded.select("ids").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("w").to_numpy()] = found.column("n").to_numpy()
    return counts


def gram_product(ids: np.ndarray, passage: np.ndarray, weight: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'A test, where the rows of A are the passages' weighted word counts, as unit vectors."""
    out = np.zeros(test.shape)
    if not len(ids):
        return out
    key = np.sort(passage * len(weight) + ids)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    passage, ids = np.divmod(key[first], len(weight))
    x = weight[ids] * np.diff(np.append(first, len(key)))
    norm, groups = _sums(x * x, passage)
    row = np.searchsorted(groups, passage)
    x = (x / np.sqrt(norm)[row]).astype(np.float32)
    projected, _ = _row_sums(test, ids, x, passage)
    by = np.argsort(ids, kind="stable")
    sums, at = _sums(projected[row[by]] * x[by, None], ids[by])
    out[at] = sums
    return out


def _summed(coded: DataFrame, items: list[list[int]], local: np.ndarray, weight: np.ndarray, test: np.ndarray) -> np.ndarray:
    """gram_product() over all passages of all texts and, with as much weight in all, the items."""
    shared = coded.sparkSession.sparkContext.broadcast((local, weight, test.astype(np.float32)))  # by words of a block, at most BLOCK
    columns = [f"c{k}" for k in range(test.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, weight, test = shared.value
        total = np.zeros(test.shape)
        for batch in batches:
            for chunk in chunks(batch, local, PASSAGE):
                total += gram_product(chunk.ids, chunk.place // PASSAGE, weight, test)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(len(columns)))], names=["w", *columns])

    found = coded.select("ids", "at").mapInArrow(run, "w long, " + ", ".join(f"{c} double" for c in columns)).groupBy("w").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    shared.unpersist()
    total = np.zeros(test.shape)
    if len(found):
        total[found.column("w").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    sizes = [len(item) for item in items]
    own = gram_product(np.array([*chain.from_iterable(items)]), np.repeat(np.arange(len(items)), sizes), weight, test.astype(np.float32))
    size, other = np.linalg.norm(total), np.linalg.norm(own)
    return total / (size or 1.0) + own / (other or 1.0)


def latent_basis(coded: DataFrame, items: list[list[int]], local: np.ndarray, weight: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the TF-IDF passages of the texts and items, and their singular values (of the scaled sum).

    Distributed randomised SVD: a first pass multiplies a random test matrix, with OVERSAMPLE more columns than the
    rank, by A'A, where A has a row for each passage; the range of that sum is orthogonalised, a second pass (a power
    step) multiplies it by A'A again, and the singular value decomposition of the small factor of Nystrom's
    approximation gives the vectors. Each task sums over its passages; the sums (words by columns) are added up on
    executors. The items are rows of A as well, lest the space miss their words.
    """
    columns = min(rank + OVERSAMPLE, len(weight))
    test = np.random.default_rng(42).standard_normal((len(weight), columns))
    span = np.linalg.qr(_summed(coded, items, local, weight, test))[0]
    image = _summed(coded, items, local, weight, span)
    image += (shift := 1e-6 * np.linalg.norm(image)) * span
    core = span.T @ image
    factor = np.linalg.solve(np.linalg.cholesky((core + core.T) / 2), image.T).T
    vectors, values, _ = np.linalg.svd(factor, full_matrices=False)
    return vectors[:, :rank], np.sqrt(np.maximum(values[:rank] ** 2 - shift, 0.0))


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of uint64, 64 to each."""
    bits = np.packbits(rows, axis=-1, bitorder="little")
    return np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 8)]).view(np.uint64)


@dataclass
class Index:
    """What the items of one block are searched by; all of it grows with the block's words alone."""

    names: list[int]
    items: list[list[int]]  # words by their numbers within the block
    local: np.ndarray  # those numbers by the scan's
    seen: np.ndarray  # documents that each word stands in
    latent: np.ndarray  # each word's weighted place in the latent space

    def __post_init__(self) -> None:
        targets = np.stack([self.latent[item].sum(axis=0) for item in self.items])
        self.targets = targets / np.maximum(np.linalg.norm(targets, axis=1), 1e-9)[:, None]
        self.scales: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            self.scales.setdefault(_width(item), []).append(k)
        self.pad = max(self.scales)
        sets, answers = np.zeros((2, len(self.items), len(self.seen)), bool)
        for k, item in enumerate(self.items):
            sets[k, item] = answers[k, item[-max(1, round(len(item) * ANSWER)) :]] = True
        self.bits, self.answer_bits = _packed(sets), _packed(answers)
        # how many different words a leak can lack: of a copy, of a paraphrase, of a paraphrase's answer
        sizes = np.array([[len(item), len(item), max(1, round(len(item) * ANSWER))] for item in self.items])
        self.lacks = np.floor(sizes * (1 - np.array([COPY, PARAPHRASE, COPY])) + 1e-6)
        self.rare: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, members in self.scales.items():
            pairs = np.array(sorted((w, k) for k in members for w in rare_words(self.items[k], self.seen)))
            fan = np.bincount(pairs[:, 0], minlength=len(self.seen))
            self.rare[width] = fan, np.cumsum(fan) - fan, pairs[:, 1]

    def by_cosine(self, chunk: Chunk, width: int, sums: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """(window's first half, item) of windows within COSINE of an item; sums are those of STEP words from `at` on."""
        members, half = np.array(self.scales[width]), width // 2
        halves, at = _row_sums(sums, np.arange(len(sums)), None, at // (half // STEP))
        both, part = halves.copy(), chunk.part(at * half)
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (part[1:] == part[:-1]))
        both[follows] += halves[follows + 1]
        least = COSINE * np.maximum(np.linalg.norm(both, axis=1), 1e-9)
        for low in range(0, len(both), 1 << 14):
            hit, which = np.nonzero(both[low : low + (1 << 14)] @ self.targets[members].T >= least[low : low + (1 << 14), None])
            yield at[low + hit] * len(self.items) + members[which]

    def by_words(self, chunk: Chunk, width: int) -> np.ndarray:
        """The same of windows whose surroundings have a rare word of the item, be their cosine what it may."""
        fan, begin, of = self.rare[width]
        hit = fan[chunk.ids] > 0
        ids, place = chunk.ids[hit], chunk.place[hit]
        times = fan[ids]
        item = of[np.repeat(begin[ids] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        half = width // 2
        found = np.unique(np.repeat(place // half, times) * len(self.items) + item)
        around = np.unique(np.concatenate([found + k * len(self.items) for k in (-2, -1, 0, 1)]))
        around = around[around >= 0]
        return around[np.isin(chunk.part(around // len(self.items) * half), np.unique(chunk.part(place)))]

    def can_be(self, chunk: Chunk, half: int, block: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the surroundings of windows from `block` on have enough different words of items; possible() denies no more."""
        out = np.zeros(len(block), bool)
        rows = max(1, TABLE // (8 * self.bits.shape[1]))
        start = 0
        while start < len(block):
            stop = int(np.searchsorted(block, block[start] + rows, side="left"))
            low, high = int(block[start]) - 1, int(block[stop - 1]) + 3
            i, j = np.searchsorted(chunk.place, [max(0, low) * half, high * half])
            ids, halves = chunk.ids[i:j], np.zeros((high - low, self.bits.shape[1]), np.uint64)
            np.bitwise_or.at(halves, (chunk.place[i:j] // half - low, ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
            around = halves[:-3] | halves[1:-2] | halves[2:-1] | halves[3:]
            for k in range(start, stop, 1 << 14):
                part = slice(k, min(stop, k + (1 << 14)))
                region, of = around[block[part] - 1 - low], item[part]
                lacks = np.bitwise_count(~region & self.bits[of]).sum(axis=1)
                copy, paraphrase, answer = self.lacks[of].T
                out[part] = lacks <= paraphrase
                kept = np.flatnonzero(out[part] & (lacks > copy))
                out[k + kept] = np.bitwise_count(~region[kept] & self.answer_bits[of[kept]]).sum(axis=1) <= answer[kept]
            start = stop
        return out

    def leaks(self, chunk: Chunk, best: dict[tuple[int, int], tuple[float, int, float]]) -> None:
        """Put the best leak of each row and item into best: (share, -first word, cosine)."""
        sums, at = _row_sums(self.latent, chunk.ids, None, chunk.place // STEP)
        for width, members in self.scales.items():
            half = width // 2
            codes = np.unique(np.concatenate([*self.by_cosine(chunk, width, sums, at), self.by_words(chunk, width)]))
            block, item = np.divmod(codes, len(self.items))
            kept = self.can_be(chunk, half, block, item)
            block, item = block[kept], item[kept]
            part = chunk.part(block * half)
            limit = np.append(chunk.base[1:], chunk.place[-1] + 1)[part]
            low, high = np.maximum((block - 1) * half, chunk.base[part]), np.minimum((block + 3) * half, limit)
            start, stop = np.searchsorted(chunk.place, low), np.searchsorted(chunk.place, high)
            last, region, present = -1, [], set()
            for n, (b, k) in enumerate(zip(block.tolist(), item.tolist())):
                if b != last:
                    last, region = b, chunk.ids[start[n] : stop[n]].tolist()
                    present = set(region)
                words = self.items[k]
                if not possible(words, present):
                    continue
                share, leak = verdict(words, region)
                key = (int(chunk.row[part[n]]), k)
                first = int(low[n] - chunk.base[part[n]] + chunk.shift[part[n]])
                if leak and (share, -first) > best.get(key, (0.0, 0))[:2]:
                    i, j = np.searchsorted(chunk.place, [max(b * half, low[n]), min((b + 2) * half, limit[n])])
                    vector = self.latent[chunk.ids[i:j]].sum(axis=0)
                    best[key] = share, -first, float(self.targets[k] @ vector / max(np.linalg.norm(vector), 1e-9))


def _search(coded: DataFrame, index: Index, schema: str) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int, float]] = {}
            for chunk in chunks(batch, index.local, index.pad, 2 * index.pad):
                index.leaks(chunk, best)
            if best:
                keys = sorted(best)
                rows = pa.array([r for r, _ in keys])
                arrays = [batch.column("doc_id").take(rows), pa.array([index.names[i] for _, i in keys], pa.int64())]
                arrays += [pa.array([round(best[k][0], 6) for k in keys]), pa.array([round(best[k][2], 4) for k in keys]), pa.array([-best[k][1] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column("h").take(rows)], names=["doc_id", "item_id", "overlap", "cosine", "first_word", "h"])

    return coded.mapInArrow(run, schema)


def _blocks(items: list[tuple[int, list[int]]]) -> Iterator[list[tuple[int, list[int]]]]:
    """The items in blocks of at most BLOCK words, one item at least."""
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, cosine, first_word, h) for every row of docs and item of benchmark(item_id, text) that it leaks.

    Words of the items are weighted by inverse frequency over all documents, none of them by nothing, and projected on a
    latent space (latent_basis); every window of every whole text, at the power-of-two width that holds the item, is a
    candidate if its cosine with the item is COSINE or more. Whatever the cosine, so is every window whose
    surroundings have a rare word of the item (rare_words): windows begin every half width, never reach into another
    text, and none of them that is a leak is left out, however common the item's words are. A candidate's
    surroundings are aligned with the item by longest common subsequence (verdict); the best place by document and
    item is returned, the first of equals, with the word its region starts at and h, a hash of the document's text.

    The texts are scanned once for all items of up to SCAN words (encode) and staged as numbers; the items' blocks of up
    to BLOCK words, each with a space of its own, read those. What is broadcast or comes to the driver is bounded by
    these two.
    Items of no words and null texts match nothing; rows of null or equal doc_ids are each reported, as are repeated
    items; empty tables give no rows; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, overlap double, cosine double, first_word long, h long"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("h"))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    scans = (wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * SCAN) + 1  # a word has a byte and a gap at least
    found = spark.createDataFrame([], schema)
    for k in range(scans):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k).orderBy("item_id", "text").collect()
        items = [(r["item_id"], w) for r in rows if (w := split(r["text"].encode()))]
        if not items:
            continue
        known = sorted(set(chain.from_iterable(w for _, w in items)))
        number = {w: n for n, w in enumerate(known)}
        coded = stage(encode(texts, known))
        seen, n = document_frequencies(coded, len(known)), coded.count()
        for block in _blocks([(name, [number[w] for w in words]) for name, words in items]):
            mine = np.unique(np.concatenate([w for _, w in block]))
            local = np.full(len(known), -1, np.int32)
            local[mine] = np.arange(len(mine))
            numbered = [local[w].tolist() for _, w in block]
            weight = np.log((n + 1) / (seen[mine] + 0.5))
            basis, _ = latent_basis(coded, numbered, local, weight)
            index = Index([name for name, _ in block], numbered, local, seen[mine], (basis * weight[:, None]).astype(np.float32))
            found = found.unionByName(_search(coded, index, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item of the benchmark, with all their columns, whatever their names.

    A row goes if a row of its doc_id and text leaks, so repeated rows share a fate; rows of null texts and, whatever
    their doc_id, rows that leak nothing stay; empty tables drop nothing.
    """
    return drop_rows(docs, find_leaks(docs, benchmark))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks() for all documents and all items of the benchmark; nulls, ties, repeats and empty tables as there."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")
