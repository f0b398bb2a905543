"""Near-duplicates by SimHash fingerprints, linked with vantage-point trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blobs, drop_rows, partitions, runs, stage, table, text_hash, unstage, unused
from .components import connected_components


@dataclass(frozen=True)
class Scheme:
    """How texts are printed and prints are linked.

    Prints are `longs` numbers of 64 bits and link at `radius` or fewer differing bits. `blocks` are the (number,
    first bit, bits) of the bit ranges by which prints are dealt to shards: prints meet if they agree on one. Where
    `similarity` is given, such prints are candidates only, and texts link that share it of their sets of shingles.
    """

    size: int = 4
    longs: int = 1
    radius: int = 4
    blocks: tuple[tuple[int, int, int], ...] = ((0, 0, 13), (0, 13, 13), (0, 26, 13), (0, 39, 13), (0, 52, 12))
    similarity: float = 0.0


#: Links at 4 bits, of which none is missed: five disjoint blocks, so that linked prints agree on one entirely.
EXACT = Scheme()
#: Shingles of five words of which two texts share 0.8: 256 bits of which 39 differ by expectation (the angle between
#: the texts' shingle sets), with a standard deviation of 6; 56 is three of them above. A pair at that similarity agrees
#: on one of the 20 blocks with probability 0.95, one at 0.9 with 0.999; whatever they miss meets by its shingles.
SIMILAR = Scheme(5, 4, 56, tuple((n, 12 * k, 12) for n in range(4) for k in range(5)), 0.8)
#: Candidates of each print, in each of its shards, that are compared as texts in the first round, and by how much that grows each round.
MOST, GROWTH = 1, 8
#: Pairs that are compared in one task's memory, with the sets of their texts.
PAIRS = 20_000
#: Up to so many texts to compare, their hashes (8 bytes each) are broadcast to the scan of all texts.
FEW = 1_000_000
#: A shard of more fingerprints is split again by distance from a vantage point; a tree's leaf has LEAF at most.
SHARD, LEAF = 50_000, 64
#: Up to so many shards' names or vantage points are broadcast to their rows, and keys that a hot component's rows are dealt to.
VANTAGES, SALTS = 100_000, 64
#: A shingle that over CROWD prints have among their first is a late choice; LATE bounds how many are (8 bytes each go to every task).
CROWD, LATE = 1000, 4_000_000
#: Bits of the parity map of a text's set of shingles, at least.
PARITY = 1024
#: Words of parity maps that are held against each other at a time.
MAPS = 1 << 20
#: What the names of the shards of shingles begin with.
SHINGLE = "s"
_SHINGLES = 1 << 14
_SEEDS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _derived(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Further 64-bit hashes of what `hashes` are of; seed 0 leaves them as they are."""
    if not seed:
        return hashes
    x = (hashes ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in chunks; fewer words than `size` are a single shingle."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(words))
    xxh64 = xxhash.xxh64_intdigest
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    for k in range(0, len(first), _SHINGLES):
        yield np.array([xxh64(joined[i:j], 42) for i, j in zip(first[k : k + _SHINGLES], last[k : k + _SHINGLES])], np.uint64)


def _print(chunks: Iterator[np.ndarray], longs: int) -> np.ndarray:
    counts, total = np.zeros((longs, 64), np.int64), 0
    for hashes in chunks:
        total += len(hashes)
        for n in range(longs):
            counts[n] += np.unpackbits(_derived(hashes, _SEEDS[n]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes, size: int = 4, longs: int = 1) -> np.ndarray:
    """SimHash of a text's word shingles as uint64 numbers; no words give 0, fewer than `size` a single shingle."""
    return _print(shingles(text, size), longs)


def parity_map(hashes: np.ndarray, bits: int = 0) -> np.ndarray:
    """For a set of shingles (distinct hashes) whether an odd number of them falls on each of `bits` (PARITY) bits, as uint64.

    Two maps differ in no more bits than the sets have members that are not common to both, so they tell apart sets
    of too little similarity without an error on the other side.
    """
    bits = bits or PARITY
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def whole_map(hashes: np.ndarray) -> np.ndarray:
    """parity_map() of the power of two of bits that gives each shingle one, PARITY at least.

    The maps of two sets of many more shingles than bits differ in about half of them, whatever the sets share. The
    exclusive or of a map's halves is the map of half as many bits.
    """
    return parity_map(hashes, max(PARITY, 1 << max(0, len(hashes) - 1).bit_length()))


def _columns(scheme: Scheme) -> list[str]:
    return [f"f{n}" for n in range(scheme.longs)]


def _texts(docs: DataFrame, *ids: str) -> DataFrame:
    """Ids as longs, the text and h, a hash of it."""
    return docs.select(*(F.col(i).cast("long").alias(i) for i in ids), F.col("text").cast("string").alias("text"), text_hash().alias("h"))


def first_shingles(hashes: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """The first of a set's sorted hashes, as many as it takes for two sets that share `similarity` to have one in common.

    All sets go by one order: hashes in `late` (sorted) after all others, else by number. Two sets A and B of that
    similarity share at least that part of either, so the least common member is among the first
    |A| - similarity * |A| + 1 of A, and likewise of B (prefix filter).
    """
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    if not len(late):
        return hashes[:n]
    is_late = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
    return np.concatenate([hashes[~is_late], hashes[is_late]])[:n]


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, h: a hash of the text, f0, ...: the print's bits as longs) of every whole text; a null text has no words.

    A scheme with a similarity prints the text's set of shingles, without repeats, and adds `node`, a hash of that set,
    `n`, its size, `parity`, its whole_map(), and `first`, its first_shingles().
    """
    columns = _columns(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, more = [], []
            for text in blobs(batch.column(1)):
                chunks = shingles(text, scheme.size)
                if scheme.similarity:
                    distinct = np.unique(np.concatenate([*chunks, np.zeros(0, np.uint64)]))
                    chunks = iter([distinct])  # print and similarity measure the same set
                    first = first_shingles(distinct, scheme.similarity, np.zeros(0, np.uint64))
                    more.append((xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63), len(distinct), whole_map(distinct).tobytes(), first.view(np.int64)))
                prints.append(_print(chunks, scheme.longs))
            found = np.array(prints, np.uint64).view(np.int64).reshape(-1, scheme.longs)
            arrays = [batch.column(0), batch.column(2), *(pa.array(found[:, n]) for n in range(scheme.longs))]
            if scheme.similarity:
                arrays += [pa.array(x, kind) for x, kind in zip(zip(*more) if more else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = {"doc_id": "long", "h": "long"} | dict.fromkeys(columns, "long")
    if scheme.similarity:
        kinds |= {"node": "long", "n": "long", "parity": "binary", "first": "array<long>"}
    names = list(kinds)
    return _texts(docs, "doc_id").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


class Links:
    """Union-find over positions, fed with whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = deeper


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between all of two sets of prints (rows of uint64)."""
    return sum(np.bitwise_count(a[:, None, n] ^ b[None, :, n]).astype(np.int16) for n in range(a.shape[1]))


def _compared(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of at most LEAF positions that hold all pairs of prints within `radius`; a set comes with itself or another.

    A vantage-point tree: each node splits its members at the median Hamming distance from a vantage point. By the
    triangle inequality a linked pair that the split separates lies within `radius` of the boundary, distance shell by
    distance shell, so only those shells are compared across the branches.
    """
    todo = [np.arange(len(fps))]
    while todo:
        members = todo.pop()
        if len(members) <= LEAF:
            yield members, members
            continue
        far = _distances(fps[members], fps[members[:1]])[:, 0]
        middle = int(np.median(far))
        if middle == far.max():
            middle = int(far[far < middle].max())
        todo += [members[far <= middle], members[far > middle]]
        for shell in np.unique(far[(far <= middle) & (far > middle - radius)]).tolist():
            one, two = members[far == shell], members[(far > middle) & (far <= shell + radius)]
            for i in range(0, len(one), LEAF):
                for j in range(0, len(two), LEAF):
                    yield one[i : i + LEAF], two[j : j + LEAF]


def link_shard(fps: np.ndarray, radius: int, asking: np.ndarray | None = None) -> np.ndarray:
    """For each distinct print (a row of uint64) the position of its component's first member within this shard.

    Prints that are `asking` only belong to another shard and are not held against each other. Nothing is returned for
    pairs, only roots.
    """
    links = Links(len(fps))
    asking = np.zeros(len(fps), bool) if asking is None else asking
    for one, two in _compared(fps, radius):
        halves = [(one[~asking[one]], two)] if one is two else [(one[~asking[one]], two), (one[asking[one]], two[~asking[two]])]
        for left, right in halves:
            if len(left) and len(right):
                x, y = np.nonzero(_distances(fps[left], fps[right]) <= radius)
                links.add(left[x], right[y])
    return links.root


def similar_enough(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, maps: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs of positions whether their sets of shingles can share `similarity`; no pair that does is denied.

    |A and B| / |A or B| >= s means that A and B differ in at most (|A| + |B|) (1 - s) / (1 + s) members.
    """
    differ = np.zeros(len(one), np.int64)
    for n in range(maps.shape[1]):
        differ += np.bitwise_count(maps[one, n] ^ maps[two, n])
    a, b = sizes[one], sizes[two]
    return np.maximum(differ, np.abs(a - b)) <= (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6


class Maps:
    """whole_map()s of sets of all sizes, one after another."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) >> 3 for m in maps], np.int64)
        self.starts = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(maps), np.uint64)

    def folded(self, at: np.ndarray, words: int, width: int) -> np.ndarray:
        """The maps at some positions, which have so many words each, folded to `width` words, a row each."""
        return np.bitwise_xor.reduce(self.flat[self.starts[at][:, None] + np.arange(words)].reshape(len(at), words // width, width), axis=1)

    def least(self) -> np.ndarray:
        """All maps folded to PARITY bits."""
        width = PARITY >> 6
        rows = np.zeros((len(self.words), width), np.uint64)
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == words)
            for k in range(0, len(at), step := max(1, MAPS // words)):
                rows[at[k : k + step]] = self.folded(at[k : k + step], words, width)
        return rows

    def similar_enough(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
        """similar_enough() by the whole maps, the longer of two folded to the shorter."""
        kept = np.zeros(len(one), bool)
        for x, y in np.unique(np.stack([self.words[one], self.words[two]]), axis=1).T.tolist():
            at = np.flatnonzero((self.words[one] == x) & (self.words[two] == y))
            for k in range(0, len(at), step := max(1, MAPS // max(x, y))):
                some, width = at[k : k + step], min(x, y)
                n = len(some)
                both = np.concatenate([self.folded(one[some], x, width), self.folded(two[some], y, width)])
                kept[some] = similar_enough(np.arange(n), np.arange(n, 2 * n), np.concatenate([sizes[one[some]], sizes[two[some]]]), both, similarity)
        return kept


def nearest(fps: np.ndarray, roots: np.ndarray, radius: int, most: int, possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, tree: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Each print with its `most` nearest prints of another component, as pairs of positions within `radius`.

    Pairs of positions that `possible` denies are no pairs. `tree` gives other prints, and a radius that pairs also are
    within by those, for the vantage-point tree to prune by. The third value tells whether any print has more of them.
    A tie goes to the smaller position.
    """
    held, waiting, size, more = np.zeros((3, 0), np.int64), [], 0, False

    def trimmed() -> tuple[np.ndarray, bool]:
        rows = np.concatenate([held, *waiting], axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        near = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0]) < most
        return rows[:, near], not near.all()

    for one, two in _compared(*(tree or (fps, radius))):
        d = _distances(fps[one], fps[two])
        x, y = np.nonzero((d <= radius) & (roots[one][:, None] != roots[two]))
        if possible and len(x):
            kept = possible(one[x], two[y])
            x, y = x[kept], y[kept]
        if not len(x):
            continue
        rows = np.stack([one[x], d[x, y], two[y]])
        waiting += [rows] if one is two else [rows, rows[::-1]]
        size += len(x)
        if size > 1 << 19:
            held, cut = trimmed()
            waiting, size, more = [], 0, more or cut
    if not waiting:
        return held[0], held[2], more
    held, cut = trimmed()
    return held[0], held[2], more or cut


def _split(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """rows(shard, node, f0, ..., more) with `asking`, in shards of at most SHARD members where vantage points can part them.

    A vantage-point tree over shards. In each round a crowded shard takes one of its members as vantage point and is
    parted at the median Hamming distance m from it. By the triangle inequality linked prints on both sides have
    distances within the radius of m, so members beyond m by no more than the radius also go to the near side, to ask
    there; what asks already goes to each side that it can have links in. The last parts are the tree's leaves.
    """
    columns, r = _columns(scheme), scheme.radius
    rows, level = rows.withColumn("asking", F.lit(False)), 0
    print_, done = F.struct(*columns), []
    while True:
        members = rows.filter("not asking")
        seed = F.xxhash64(*columns, F.lit(level))
        crowded = members.groupBy("shard").agg(F.count("*").alias("members"), F.min_by(print_, F.struct(seed, *columns)).alias("v")).filter(F.col("members") > SHARD)
        crowded = stage(crowded)
        n = crowded.count()
        if not n:
            for part in done:
                rows = rows.unionByName(part)
            return rows
        few = F.broadcast if n <= VANTAGES else lambda df: df
        far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"v.{c}"))) for c in columns), F.lit(0))
        counts = members.join(few(crowded), "shard").groupBy("shard", "members", far.alias("d")).agg(F.count("*").alias("n"))
        by = Window.partitionBy("shard")
        below = counts.withColumns({"upto": F.sum("n").over(by.orderBy("d")), "top": F.max("d").over(by)})  # a row a distance
        middle = F.least(F.min(F.when(2 * F.col("upto") >= F.col("members"), F.col("d"))), F.max(F.when(F.col("d") < F.col("top"), F.col("d"))))
        cuts = crowded.select("shard", "v").join(below.groupBy("shard").agg(middle.alias("m")), "shard")
        cuts = stage(cuts)
        done.append(rows.join(few(crowded.select("shard")), "shard", "left_anti"))
        side = lambda name, asks: F.struct(F.lit(name).alias("side"), asks.alias("asks"))
        near_, far_ = far <= F.col("m"), far > F.col("m")
        near = F.when(near_, side("n", F.col("asking"))).when(far <= F.col("m") + r, side("n", F.lit(True)))
        away = F.when(far_, side("f", F.col("asking"))).when(F.col("asking") & (far > F.col("m") - r), side("f", F.lit(True)))
        parted = rows.join(few(cuts), "shard").withColumn("to", F.explode(F.filter(F.array(near, away), lambda x: x.isNotNull())))
        kept = [c for c in rows.columns if c not in ("shard", "asking")]
        rows = stage(parted.select(F.concat("shard", "to.side").alias("shard"), *kept, F.col("to.asks").alias("asking")))
        level += 1


def _routed(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """nodes(node, f0, ..., more columns) with their shard, of each of the print's blocks, and asking (_split)."""
    blocks = [F.shiftrightunsigned(f"f{n}", at).bitwiseAND((1 << bits) - 1) + (tree << 13) for tree, (n, at, bits) in enumerate(scheme.blocks)]
    dealt = nodes.select(F.explode(F.array(*blocks)).alias("block"), *nodes.columns)
    return _split(dealt.select(F.concat(F.col("block").cast("string"), F.lit("/")).alias("shard"), *nodes.columns), scheme)


def near_links(nodes: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(a, b) of distinct prints nodes(node, f0, ...): links that join all those, and only those, of one component."""
    columns = _columns(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "shard"):
            asks = rows.column("asking").to_numpy()
            order = np.lexsort((asks, rows.column("node").to_numpy()))
            node, at = np.unique(rows.column("node").to_numpy()[order], return_index=True)
            at = order[at]  # a member's own row comes before those in which it asks
            fps = np.stack([rows.column(c).to_numpy()[at] for c in columns], axis=1).view(np.uint64)
            roots = link_shard(fps, scheme.radius, asks[at])
            tied = np.flatnonzero(roots != np.arange(len(fps)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[roots[tied]])], names=["a", "b"])

    routed = _routed(nodes.select("node", *columns), scheme).repartition(partitions(nodes.sparkSession), "shard").sortWithinPartitions("shard")
    return routed.mapInArrow(run, "a long, b long")


def _candidates(routed: DataFrame, scheme: Scheme, most: int) -> DataFrame:
    """(shard, a, b) of prints by nearest(); a and b are null in a row more for a shard where a print has more.

    Only pairs count that can have the scheme's similarity by their n and whole maps. The shards of shingles know no
    radius of the prints; their tree is one of the maps, by which no pair of that similarity is further apart than
    similar_enough() allows.
    """
    columns = _columns(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, "shard"):
            if len(rows) < 2:
                continue
            node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
            fps = np.stack([rows.column(c).to_numpy()[at] for c in columns], axis=1).view(np.uint64)
            radius, tree = scheme.radius, None
            sizes = rows.column("n").to_numpy()[at]
            whole = Maps(rows.column("parity").take(pa.array(at)).to_pylist())
            least = whole.least()

            def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                kept = similar_enough(x, y, sizes, least, scheme.similarity)  # noqa: B023
                long = np.flatnonzero(kept & (np.minimum(whole.words[x], whole.words[y]) > least.shape[1]))  # noqa: B023
                if len(long):
                    kept[long] = whole.similar_enough(x[long], y[long], sizes, scheme.similarity)  # noqa: B023
                return kept

            if shard.startswith(SHINGLE):
                radius = 64 * scheme.longs
                tree = least, int(2 * sizes.max() * (1 - scheme.similarity) / (1 + scheme.similarity) + 1e-6)
            one, two, more = nearest(fps, rows.column("root").to_numpy()[at], radius, most, possible, tree)
            if not len(one):
                continue
            ends = [[*f(node[one], node[two]).tolist(), *[None] * more] for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ends[0])), *(pa.array(x, pa.int64()) for x in ends)], names=["shard", "a", "b"])

    dealt = routed.repartition(partitions(routed.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard string, a long, b long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, pick: Callable[[np.ndarray], np.ndarray] = lambda hashes: hashes) -> DataFrame:
    """(node, s: sorted distinct hashes of shingles, or what `pick` takes of them) for wanted(node, h), from any text of that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node not in done:  # copies of one text
                    done.add(node)
                    found = [*shingles(blobs(pa.array([text.as_py()], pa.string()))[0], size), np.zeros(0, np.uint64)]
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([pick(np.unique(np.concatenate(found))).view(np.int64)], pa.list_(pa.int64()))], names=["node", "s"])

    few = wanted.count() <= FEW
    picked = _texts(docs).join(F.broadcast(wanted) if few else wanted, "h").select("node", "text")
    return picked.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the staged pairs(shard, a, b) whose sets(node, s), of sizes(node, n), share `similarity`.

    The pairs of a shard meet with its sets, each of which is moved once, not once a pair; a shard of many pairs is cut
    by hashes of a into lots of about PAIRS. A set goes to every lot that asks for it, long texts' to many: lots are
    taken in waves, one after another, in each of which about as much is moved as all the sets are, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "lot"):
            given = rows.filter(rows.column("s").is_valid())
            held = dict(zip(given.column("a").to_pylist(), (x.values.to_numpy() for x in given.column("s"))))
            asked = rows.filter(rows.column("b").is_valid())
            ends = []
            for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
                common = len(np.intersect1d(held[a], held[b], assume_unique=True))
                if common >= similarity * (len(held[a]) + len(held[b]) - common) - 1e-9:
                    ends.append((a, b))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends)], names=["a", "b"])

    many = pairs.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS).withColumnRenamed("shard", "_shard")
    part = F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PAIRS)), F.lit(0))
    asked = pairs.join(many, F.col("shard") == F.col("_shard"), "left").select(F.concat_ws("/", "shard", part.cast("string")).alias("lot"), "a", "b")
    asked = stage(asked)
    needed = stage(asked.select("lot", F.explode(F.array("a", "b")).alias("node")).distinct())
    moved = needed.groupBy("node").agg(F.count("*").alias("lots")).join(sizes, "node")
    total, own = moved.agg(F.sum(F.col("lots") * F.col("n")), F.sum("n")).first()
    waves, done = -(-(total or 1) // (own or 1)), []
    for wave in range(waves):
        now = F.pmod(F.xxhash64("lot"), F.lit(waves)) == wave
        given = needed.filter(now).join(sets, "node")
        rows = asked.filter(now).withColumn("s", F.lit(None).cast("array<bigint>")).unionByName(given.select("lot", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "s"))
        done.append(stage(rows.repartition(partitions(pairs.sparkSession), "lot").sortWithinPartitions("lot").mapInArrow(run, "a long, b long")))
    unstage(asked, needed)
    return reduce(DataFrame.unionByName, done)


def shingle_shards(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(shard, node): a shard for each shingle that several of nodes(node, h, first) have among their first_shingles().

    Two sets that share scheme.similarity meet in one of them, without exception. A shingle that over CROWD sets have
    there (of a common line) is ranked last and the choice made again for those sets, so that a crowd meets only by
    shingles of sets that have hardly any others: copies of each other, more or less. Of shards with the same members
    (told by their number and a 64-bit sum) one is enough.
    """
    postings, late = stage(nodes.select("node", F.explode("first").alias("s"))), np.zeros(0, np.uint64)
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")]
    while True:
        several = stage(postings.groupBy("s").agg(*members).filter("n > 1"))
        hot = several.filter(F.col("n") > max(CROWD, postings.count() // LATE)).select("s")
        new = np.setdiff1d(hot.toArrow().column(0).to_numpy().view(np.uint64), late)  # at most LATE
        if not len(new):
            break
        late = np.union1d(late, new)
        again = stage(postings.join(F.broadcast(hot), "s", "left_semi").select("node").distinct().join(nodes.select("node", "h"), "node"))
        shared = docs.sparkSession.sparkContext.broadcast(late)
        chosen = _shingle_sets(docs, again, scheme.size, lambda hashes: first_shingles(hashes, scheme.similarity, shared.value))
        asked = again.select("node")
        rest = postings.join(F.broadcast(asked) if again.count() <= FEW else asked, "node", "left_anti")
        last, postings = postings, stage(rest.unionByName(chosen.select("node", F.explode("s").alias("s"))))
        unstage(last, several, again)
    kept = stage(several.groupBy("n", "x").agg(F.min("s").alias("s")).select("s"))
    shards = stage(postings.join(F.broadcast(kept) if kept.count() <= FEW else kept, "s", "left_semi").select(F.concat(F.lit(SHINGLE), F.hex("s")).alias("shard"), "node"))
    unstage(postings, several, kept)
    return shards


def similar_links(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b) of nodes(node, h, f0, ..., n, parity, first) whose texts share scheme.similarity of their shingles.

    The links join all those of one component, but are not all links. Prints meet in the shards of their blocks, within
    the scheme's radius, and in those of their shingles (shingle_shards), which no pair of that similarity escapes. In
    each round every print is compared, as a set of shingles, with its nearest candidates of other components, and
    shards where a print has further ones go into the next round, with GROWTH times as many. So a group of near copies
    costs a few pairs a text, no candidate between components is left out or compared twice, and the rounds grow with
    the logarithm of the largest group. Candidates also have to pass the parity maps of their sets where they are
    sought, so that a crowd that is a little less alike than the similarity isn't compared pair by pair, and hardly a
    set is moved but for pairs near that similarity, however many texts a block's prints bring together. A map is a
    64th to a 32nd of its set, or 128 bytes.
    """
    columns, most, links, marked, tried = _columns(scheme), MOST, None, None, None
    by_shingle, carried = shingle_shards(docs, nodes, scheme), ["n", "parity"]
    rooted = nodes.select("node", *columns, F.col("node").alias("root"), *carried)
    fields = ["shard", "node", *columns, "root", *carried]
    while True:
        routed, shingled = _routed(rooted, scheme), by_shingle
        if marked is not None:
            few = F.broadcast(marked) if marked.count() <= VANTAGES else marked  # most rows stay where they are
            routed, shingled = (x.join(few, "shard", "left_semi") for x in (routed, shingled))
        shingled = shingled.join(rooted, "node")
        found = stage(_candidates(routed.select(fields).unionByName(shingled.select(fields)), scheme, most))
        pairs = found.filter("a is not null").groupBy("a", "b").agg(F.min("shard").alias("shard"))
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(ends.join(nodes.select("node", "h"), "node"))
        sets = stage(_shingle_sets(docs, wanted, scheme.size))
        passed = compared(pairs, sets, nodes.select("node", "n"), scheme.similarity)
        links = stage(passed if links is None else links.unionByName(passed))
        unstage(wanted, sets)
        marked = stage(found.filter("a is null").select("shard").distinct())
        unstage(found)
        if marked.isEmpty():
            return links
        roots = connected_components(links).withColumnRenamed("node", "_node")
        links = roots.filter("_node <> root").select(F.col("_node").alias("a"), F.col("root").alias("b"))
        joined = nodes.join(roots, F.col("node") == F.col("_node"), "left")
        rooted = stage(joined.select("node", *columns, F.coalesce("root", "node").alias("root"), *carried))
        most *= GROWTH


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Prints within the scheme's radius are linked, or, if the scheme has a similarity, texts that share it; links are
    transitive; component_id is the smallest doc_id reachable. Equal prints (or sets of shingles) meet as one node, so
    copies cost a group, not pairs. Nodes are dealt to the shards of the scheme's blocks (within EXACT, two linked
    prints agree on one block), shards of over SHARD nodes are parted by vantage points again and again, with the
    overlap that the triangle bound asks for (_split), and each shard is searched by a vantage-point tree. Repeated
    rows give repeated rows; a null doc_id links like any other but is never a component_id unless the whole component
    has none; null and empty texts have no words and link with each other; ties don't matter; an empty table gives no
    rows; other columns are ignored.
    """
    columns = _columns(scheme)
    return _components(docs, scheme).select("doc_id", F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in columns)).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def _components(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Every row's doc_id, h (hash of the text) and print, and least, the smallest (doc_id, h) with a doc_id of its component."""
    columns = _columns(scheme)
    prints = fingerprints(docs, scheme)
    prints = stage(prints if scheme.similarity else prints.withColumn("node", F.col("f0")))
    more = [F.first(c).alias(c) for c in ("n", "parity", "first")] if scheme.similarity else []  # equal sets have them alike
    nodes = stage(prints.groupBy("node", *columns).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("least"), F.min("h").alias("h"), *more))
    links = similar_links(docs, nodes, scheme) if scheme.similarity else near_links(nodes, scheme)
    linked = connected_components(links).join(nodes.select("node", "least"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("shared")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = linked.select("node", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")).join(least, ["root", "salt"]).select("node", "shared")
    found = nodes.select("node", "least").join(shared.withColumn("linked", F.lit(True)), "node", "left")
    found = found.select("node", F.when(F.col("linked"), F.col("shared")).otherwise(F.col("least")).alias("least"))
    return prints.join(found, "node").select("doc_id", "h", *columns, "least")


def keep_one(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: that of the smallest doc_id, then hash of the text.

    Rows are told apart by doc_id and text, so different texts may share a doc_id. Of rows that share both one stays.
    Rows without a doc_id stay unless their component has one. Null and empty texts are a component; an empty table
    stays empty.
    """
    found = stage(_components(docs, scheme).select("doc_id", "h", "least"))
    other = ~F.col("doc_id").eqNullSafe(F.col("least.doc_id")) | (F.col("h") != F.col("least.h"))
    kept = drop_rows(docs, found.filter(F.col("least").isNotNull() & other).select("doc_id", "h"))
    again = found.filter("doc_id is not null").groupBy("doc_id", "h").count().filter("count > 1")
    if again.isEmpty():
        return kept
    (mark,) = unused(docs, "text_hash")
    named = kept.filter("doc_id is not null").withColumn(mark, text_hash()).dropDuplicates(["doc_id", mark]).drop(mark)
    return named.unionByName(kept.filter("doc_id is null"))


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents by EXACT; nulls, ties, repeats and empty tables as there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
