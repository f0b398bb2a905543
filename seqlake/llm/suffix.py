"""Repeated byte strings found with suffix arrays, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, flat, partitions, quoted, slices, stage, table, unstage

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of the grams that anchor windows; hashed by doubling, so a power of two.
GRAM = 32
#: Bytes of text taken into numpy at a time, bytes of the pieces that a longer text is cut into, and bytes of one suffix array.
CHUNK, PIECE, SHARD = 1 << 18, 1 << 20, 1 << 20
#: A gram with more different surroundings than CROWD is a late choice as anchor. LATE bounds how many grams are (8 bytes
#: each go to every task): where there are over CROWD * LATE surroundings in all, the limit rises with them.
CROWD, LATE = 10_000, 4_000_000

_SEEDS = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_POSITION = 21  # bits for positions within a chunk, which has at most 2 MB unless a single text is longer


def _mix(x: np.ndarray) -> np.ndarray:
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position, by doubling."""
    x, at = _mix(_SEEDS[data]), 1
    while at < size:
        y = x[:-at] * np.uint64(0xD6E8FEB86659FD93)
        y += x[at:]
        x = _mix(y)
        at *= 2
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, late: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hash of the anchor's gram) of every anchor.

    The anchor of a window of `length` bytes is its gram of the least rank, the leftmost of several, so equal windows
    have equal anchors at equal places, wherever they stand. Grams in `late` (sorted hashes) come after all others.
    Windows that share an anchor are a run. Windows never leave their text.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data, gram)
    rank = hashes >> np.uint64(1)
    if len(late):
        rank |= (late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes).astype(np.uint64) << np.uint64(63)
    bits = np.uint64(max(_POSITION, int(len(data)).bit_length()))
    best = (rank & ~((np.uint64(1) << bits) - np.uint64(1))) | np.arange(len(rank), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])  # windows of have + step grams
        have += step
    place = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = (np.arange(n) + length) <= np.repeat(offsets[1:], sizes)[:n]
    edge = np.ones(n, bool)
    edge[1:] = (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    first, last = first[inside[first]], last[inside[first]]
    return text[first], first, last, hashes[place[first]]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes that follow them (the end comes before any byte).

    Larsson and Sadakane's refinement: positions ranked by their first h bytes are ranked by 2h bytes with the ranks
    h further on, and only groups that are still tied are sorted again.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key * np.uint64(257) + padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1  # the end has rank 0
    h = 7
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while h < depth and len(tied):
        at = order[tied]
        group, then = rank[at], rank[np.minimum(at + h, n)]
        by = np.argsort(group * np.int64(n + 1) + then, kind="stable")
        order[tied] = at = at[by]
        group, then = group[by], then[by]
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def _extend(data: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix from positions a and b, of which `known` bytes are known to agree."""
    length, going = known.copy(), np.flatnonzero(known < most)
    while len(going):
        x, y = a[going] + length[going], b[going] + length[going]
        going, x, y = going[(inside := np.maximum(x, y) < len(data))], x[inside], y[inside]
        going = going[data[x] == data[y]]
        length[going] += 1
        going = going[length[going] < most]
    return length


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each rank the bytes, up to `most`, that the position there shares with the one before it in `order`.

    Kasai's rule, a position's length is at least its left neighbour's less one, in strides: known lengths bound those
    at half the stride from below, and only the rest is compared. A bound counts if the neighbour's partner, moved
    along, stands before the position in `order`. Positions that `order` leaves out stay undefined.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.full(len(data), -1, np.int64)
    rank[order] = np.arange(len(order))
    length = np.zeros(len(data), np.int64)
    stride = 32
    fresh = np.arange(0, len(data), stride)
    while stride:
        real = fresh[before[fresh] >= 0]
        back = real - stride
        partner = np.where((back >= 0) & (real % (2 * stride) != 0) & (before[back] >= 0), before[back] + stride, len(data) - 1)
        partner = np.minimum(partner, len(data) - 1)
        holds = (rank[partner] >= 0) & (rank[partner] < rank[real]) & (partner == before[back] + stride)
        length[real] = _extend(data, real, before[real], np.where(holds, np.maximum(length[back] - stride, 0), 0), most)
        stride //= 2
        fresh = np.arange(stride, len(data), 2 * stride) if stride else fresh
    return length[order]


def lower_bound(data: np.ndarray, order: np.ndarray, other: np.ndarray, queries: np.ndarray, length: int) -> np.ndarray:
    """For each query position of `other` whether `length` bytes there stand at a position of the sorted `order`."""
    if not len(order) or not len(queries):
        return np.zeros(len(queries), bool)

    def keys(source: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(source, length)[at]
        return np.ascontiguousarray(rows).view(f"V{length}").ravel()

    wanted = keys(other, queries)
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    for _ in range(int(len(order)).bit_length()):
        middle = (low + high) // 2
        here = np.minimum(middle, len(order) - 1)
        a = np.lib.stride_tricks.sliding_window_view(data, length)[order[here]]
        b = wanted.view(np.uint8).reshape(-1, length)
        differs = a != b
        at = differs.argmax(axis=1)
        row = np.arange(len(b))
        less = (a[row, at] < b[row, at]) & (middle < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    found = np.minimum(low, len(order) - 1)
    return (keys(data, order[found]) == wanted) & (low < len(order))


class Shard:
    """Contexts of one suffix array: which of their windows stand at two places or more."""

    def __init__(self, contexts: list[bytes], copied: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(c) + 1 for c in contexts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.windows = sizes - length  # of each context
        self.data = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # never a byte of UTF-8
        self.context = np.repeat(np.arange(len(contexts)), self.windows)
        self.place = np.arange(len(self.context)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows) + self.starts[self.context]
        mine = np.zeros(len(self.data), bool)
        mine[self.place] = True
        order = suffix_array(self.data, length)
        self.order = order[mine[order]]
        shared = common_prefixes(self.data, self.order, length) >= length
        again = shared.copy()
        again[:-1] |= shared[1:]
        found = np.zeros(len(self.data), bool)
        found[self.order[again]] = True
        self.repeated = found[self.place] | copied[self.context]

    def of(self, context: int) -> slice:
        end = int(np.searchsorted(self.context, context, side="right"))
        return slice(end - int(self.windows[context]), end)

    def merge(self, other: Shard, contexts: np.ndarray, others: np.ndarray) -> None:
        """Mark the windows that given contexts of two shards share, by binary search in this one's suffix array."""
        inside = np.zeros(len(self.data), bool)
        chosen = np.isin(self.context, contexts)
        inside[self.place[chosen]] = True
        order = self.order[inside[self.order]]
        asked = np.flatnonzero(np.isin(other.context, others))
        hit = lower_bound(self.data, order, other.data, other.place[asked], self.length)
        other.repeated[asked[hit]] = True
        back = np.argsort(other.place[asked])
        theirs = other.order[np.isin(other.order, other.place[asked][back])]
        mine = np.flatnonzero(chosen)
        self.repeated[mine[lower_bound(other.data, theirs, self.data, self.place[mine], self.length)]] = True


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


#: The columns that tell documents apart, 96 bits of hash.
KEY = ("k", "k2")


def _different(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(KEY, text, rows) of docs(KEY, text), each KEY once with the number of its rows, and what it rests on, staged.

    Texts of keys that occur once, usually all, stay where they are; the others' are combined before they are moved.
    """
    many = stage(docs.groupBy(*KEY).agg(F.count("*").alias("rows")).filter("rows > 1"))
    once = docs.join(many, list(KEY), "left_anti").select(*KEY, "text", F.lit(1).cast("long").alias("rows"))
    again = docs.join(many, list(KEY)).groupBy(*KEY).agg(F.first("text").alias("text"), F.first("rows").alias("rows"))
    return once.unionByName(again), many


def _anchor_rows(docs: DataFrame, length: int, late: np.ndarray) -> DataFrame:
    """A row for each anchor: the document's key and rows, its windows' places, the hashes of its gram and of its context.

    A text of over four CHUNKs is cut into pieces that overlap by a window less one byte, so that each window is in
    one of them; its anchor depends on its bytes alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text", CHUNK):
            data, offsets = flat(batch.column("text"))
            whole = len(data) <= 4 * CHUNK or batch.num_rows > 1
            for start in (0,) if whole else range(0, len(data) - length + 1, PIECE):
                part = data if whole else data[start : start + PIECE + length - 1]
                text, first, last, gram = anchors(part, offsets if whole else np.array([0, len(part)]), length, GRAM, shared.value)
                raw = part.tobytes()
                context = np.array([digest(raw[i : j + length]) for i, j in zip(first.tolist(), last.tolist())], np.uint64)
                keys = [batch.column(c).take(pa.array(text)) for c in (*KEY, "rows")]
                at = (first + start - (offsets[text] if whole else 0)).astype(np.int32)  # a column's text is under 2 GB
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at), pa.array((last - first).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=[*KEY, "rows", "at", "more", "gram", "context"])

    return docs.select(*KEY, "text", "rows").mapInArrow(run, "k long, k2 int, rows long, at int, more int, gram long, context long")


def _contexts(anchored: DataFrame) -> DataFrame:
    """(gram, context, n, at): the different contexts of each gram, how many places each has, and the least of them."""
    return anchored.groupBy("gram", "context").agg(F.sum("rows").alias("n"), F.min(F.struct(*KEY, "at", "more")).alias("at"))


def _judged(texts: DataFrame, length: int) -> DataFrame:
    """(gram, context, starts, ends): runs of repeated windows, counted from the context's first window."""

    def out(shard: Shard, rows: list[tuple]) -> pa.RecordBatch:
        starts, ends = zip(*(_spans(shard.repeated[shard.of(k)]) for k in range(len(rows))))
        keep = [k for k in range(len(rows)) if len(starts[k])]
        arrays = [pa.array([rows[k][j] for k in keep], pa.int64()) for j in (0, 1)]
        arrays += [pa.array([x[k].tolist() for k in keep], pa.list_(pa.int32())) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays(arrays, names=["gram", "context", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Shard, list[tuple]]] = []  # done, but for the last one's last gram
        rows: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows, size
            shard = Shard([r[3] for r in rows], np.array([r[2] > 1 for r in rows]), length)
            for old, had in held:  # the gram that goes on from earlier shards
                if had[-1][0] == rows[0][0]:
                    pick = lambda rs: np.flatnonzero([r[0] == rows[0][0] for r in rs])
                    old.merge(shard, pick(had), pick(rows))
            if rows[0][0] != rows[-1][0]:
                while held:
                    yield out(*held.pop(0))
            held.append((shard, rows))
            rows, size = [], 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "n", "bytes"))):
                if size > SHARD:
                    yield from close()
                rows.append(row)
                size += len(row[3])
        if rows:
            yield from close()
        for x in held:
            yield out(*x)

    return texts.mapInArrow(run, "gram long, context long, starts array<int>, ends array<int>")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted context (KEY, gram, context, n, at, more), out of its document."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "context", "n", "at", "more")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            rows = [(a["gram"], a["context"], a["n"], t[a["at"] : a["at"] + a["more"] + length]) for t, asked in zip(blobs(batch.column("text")), batch.column("asked").to_pylist()) for a in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["gram", "context", "n", "bytes"])

    return docs.select(*KEY, "text").join(lists, list(KEY)).select("text", "asked").mapInArrow(run, "gram long, context long, n long, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(KEY, spans) of docs(KEY, text): for each key the runs of bytes that repeated strings cover.

    A string of `length` bytes counts if it also starts anywhere else, in the same text or another. Every window has
    an anchor by content alone, so equal windows meet under the hash of their anchor's gram; a gram with one place
    only has no repeats and its text goes no further. The different contexts of the other grams are sorted by gram,
    cut into shards of SHARD bytes, each of which gets a suffix array and common prefixes; a gram that runs over
    several shards is merged by binary search. Copies meet as one context with a count, and rows of one key are one text
    with a count from the start, so equal rows cost what one costs. A gram in a great many
    different contexts (a common line) is ranked last as an anchor and the choice made again, whereupon its windows
    spread over their other grams; those wholly inside common text have few different contexts. What is left of a
    crowd meets in one task, a shard of SHARD bytes at a time: at most the limit's contexts, of under two windows each.
    """
    late = np.zeros(0, np.uint64)
    docs, many = _different(docs)
    while True:
        anchored = stage(_anchor_rows(docs, length, late))
        contexts = stage(_contexts(anchored))
        by_gram = contexts.groupBy("gram").agg(F.sum("n").alias("places"), F.count("*").alias("kinds"))
        crowd = max(CROWD, contexts.count() // LATE)
        more = by_gram.filter(F.col("kinds") > crowd).select("gram").toArrow().column(0).to_numpy().view(np.uint64)  # at most LATE
        if np.isin(more, late).all():
            break
        late = np.union1d(late, more)
        unstage(anchored, contexts)
    again = by_gram.filter("places > 1").select("gram")
    wanted = stage(contexts.join(again, "gram").select("gram", "context", "n", "at.*"))
    unstage(contexts)
    texts = _cut(docs, wanted, length).repartition(partitions(docs.sparkSession), "gram").sortWithinPartitions("gram", "context")
    found = stage(_judged(texts, length))
    unstage(wanted)
    hit = anchored.join(found, ["gram", "context"])
    span = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct((F.col("at") + s["starts"]).alias("s"), (F.col("at") + s["ends"] - 1 + length).alias("e")))
    spans = stage(hit.groupBy(*KEY).agg(F.flatten(F.collect_list(span)).alias("spans")))
    unstage(anchored, found, many)
    return spans


def _keyed(docs: DataFrame) -> DataFrame:
    parts = (F.col("doc_id").cast("long"), F.octet_length("text"), F.col("text"))
    return docs.withColumns({"k": F.xxhash64(*parts), "k2": F.hash(*parts)})


def _merged(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """Every row of docs(doc_id, text) with what is left of its text once repeated bytes are removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `texts`, the rest as `text` beside all other
    columns of docs, whatever their names: bytes of characters that a cut left incomplete are dropped from it. A null
    text is empty (and stays null in `text`); texts shorter than `length` lose nothing; repeated rows count as places
    of their own and so lose everything they share; a null doc_id is one like another; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if texts else []
    held = F.struct(*(F.col(quoted(c)).alias(f"c{n}") for n, c in enumerate(rest)), F.lit(0).alias("none"))
    packed = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("rest"))
    keyed = _keyed(packed)
    joined = keyed.join(repeated_spans(keyed.select(*KEY, "text"), length), list(KEY), "left").select("doc_id", "text", "spans", "rest")
    figures = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string".format(docs.schema["doc_id"].dataType.simpleString())
    kinds = f"{figures}, kept string, rest {packed.schema['rest'].dataType.simpleString()}" if texts else figures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 * CHUNK):
            rows = []
            for text, null, spans in zip(blobs(batch.column("text")), batch.column("text").is_null().to_pylist(), batch.column("spans").to_pylist()):
                cut = _merged(spans)
                edges = [0, *(x for pair in cut for x in pair), len(text)]
                pieces = [text[i:j] for i, j in zip(edges[::2], edges[1::2])]
                left = b"".join(pieces)
                readable = None if null else b"".join(p.decode(errors="ignore").encode() for p in pieces).decode() if texts else ""
                rows.append((len(text), len(text) - len(left), len(cut), hashlib.sha256(left).hexdigest(), readable))
            arrays = [batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if texts:
                arrays, names = [*arrays, batch.column("rest")], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(arrays[: len(names) if texts else 5], names=names if texts else names[:5])

    done = joined.mapInArrow(run, kinds)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")} | {c: F.col("rest").getField(f"c{n}").alias(c) for n, c in enumerate(rest)}
    return done.select(*(back[c] for c in docs.columns)) if texts else done


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents; nulls, ties, repeats and empty tables as there."""
    return remove_repeats(table(spark, sf_dir, "documents"))
