"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, bit counts that bound the overlap from above, and exact
intersections of sorted arrays for what passes.

A node is a distinct text. Nodes that share a shingle among the first of either in one global order meet (the prefix principle:
sets that overlap enough must); shingles that many texts have go last in that order. A tile is such a meeting, cut by bands of
set sizes; meetings of the very same nodes are one tile. All links are found inside tiles, in rounds:

* A leader round takes one node of each component of a tile and offers each of them at most one leader, by signatures. The
  pairs are intersected exactly, leader by leader, and what links joins components. Large groups of near copies close here.
* The last round compares what is left, every two nodes of a tile in different components: sizes, then bit counts, then exact
  intersections in the tile itself, which gives only the edges that join components. So the rows that leave a tile grow with its
  nodes and not with their pairs, and no pair of different components goes uncompared.

Each text is shingled once to be counted, once for its prefix, and again only if it is in a tile or passed the bit counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, discard, released, shuffle_parts, slices, staged

WORDS, PERCENT = 5, 75
#: Common shingles: counted in stretches of so many, from so many times a stretch on; at most so many are kept, for order only.
STRETCH, OFTEN, COMMON = 2_000_000, 2, 2_000_000
#: A shingle counted at least 2 ** HOT_GRADE times is dealt in so many parts.
HOT_GRADE, SALTS = 12, 64
#: Leader rounds before all that is left is compared.
ROUNDS = 2
#: Nodes, and shingles, of one block of a tile.
BLOCK, BLOCK_SHINGLES = 2_048, 1_000_000
#: Share of signature bits in common from which a node is offered to a leader (what isn't offered is compared in the last round).
OFFER = 0.7
#: Prefixes are so long that sets which overlap enough share so many of their shingles (or all that they have in common): a
#: meeting of just two texts that comes less often is chance, as the pair would have to meet in a larger one too.
SHARED = 4
#: Texts of a meeting that come in one row.
LARGE = 4_096
#: Tiles of a node, by chance, that a leader round looks at.
LED = 8
#: Rows that are broadcast at most; beyond it the same join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are shingled at once; a longer text is alone.
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    return h ^ (h >> np.uint64(32))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word: eight bytes at a time; words of more than 64 bytes by XXH3."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[padded[:-8]], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h, on = size.astype(np.uint64), np.flatnonzero(size <= 64)
    for at in range(0, 64, 8):
        left = np.minimum(size[on] - at, 8).astype(np.uint64)
        lane = lanes[start[on] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[on] = _mixed(h[on] ^ lane)
        if not len(on := on[size[on] > at + 8]):
            break
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h, start


def _windows(w: np.ndarray, width: int) -> np.ndarray:
    n = len(w) - width + 1
    h = w[:n] + np.uint64(width)
    for k in range(1, width):
        h = _mixed(h ^ (h >> np.uint64(29))) + w[k : n + k]
    return h ^ (h >> np.uint64(29))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted, distinct 64-bit hashes of its shingles: `width` words each, or the whole sequence if shorter."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0

    def flush():
        w, start = _words(b" ".join(chunk).lower())
        first = np.cumsum([0, *(len(t) + 1 for t in chunk)])
        cut = np.searchsorted(start, first).tolist()
        h = _windows(w, width) if len(w) >= width else None
        for a, b in zip(cut, cut[1:], strict=False):
            out.append(_distinct(h[a : b - width + 1]) if b - a >= width else _windows(w[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        chunk.clear()

    for t in texts:
        data = (t or "").encode()
        if chunk and size + len(data) > CHUNK:
            flush()
            size = 0
        chunk.append(data)
        size += len(data)
    if chunk:
        flush()
    return out


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    return shingle_sets([text], width)[0]


def bits(n: int) -> int:
    """Bits of the signature of a set of n: at least four an element, at least 2,048."""
    return max(2_048, 1 << (4 * n - 1).bit_length())


def signature(h: np.ndarray) -> bytes:
    out = np.zeros(bits(len(h)), np.uint8)
    out[((h * _M2) >> np.uint64(32)).astype(np.int64) & (len(out) - 1)] = 1
    return np.packbits(out).tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of uint64 words, all as wide as the narrowest: a wider one has its halves laid over each other."""
    words, out = min(len(s) for s in signatures) // 8, []
    for s in signatures:
        a = np.frombuffer(s, np.uint64)
        while len(a) > words:
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        out.append(a)
    return np.stack(out)


def ones(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(-1, dtype=np.int64)


def most_shared(both, a, b, na, nb):
    """What the overlap is at most, for signatures with `both` bits in common and a and b bits of their own. Elements that share a
    bit with another of their own set are counted in full, so the bound never falls short."""
    return np.minimum(both + np.minimum(na - a, nb - b), np.minimum(na, nb))


def linked(shared, na, nb, percent: int = PERCENT):
    return 100 * shared >= percent * (na + nb - shared)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return linked(most_shared(ones(a & b), ones(a), ones(b), na, nb), na, nb, percent)


def prefix(h: np.ndarray, common: np.ndarray, grades: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first of a set's shingles in the global order: so many that any set which overlaps enough has SHARED of them in its own
    (or all of the overlap, if that is less)."""
    return _Order(common, grades).prefix(h, percent)[0]


class _Order:
    """The global order of shingles: by grade, 0 for those that aren't common, then by hash. A bit table tells most of the latter."""

    def __init__(self, common: np.ndarray, grades: np.ndarray):
        self.common, self.grades = common, grades
        self.table = np.zeros(1 << 23 if len(common) > 1_000 else 1 << 10, np.uint8)
        self.down = np.uint64(64 - (8 * len(self.table)).bit_length() + 1)
        at = common >> self.down
        np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def grade(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int8)
        if len(self.common):
            at = h >> self.down
            some = np.flatnonzero((self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            place = np.minimum(np.searchsorted(self.common, h[some]), len(self.common) - 1)
            out[some] = np.where(self.common[place] == h[some], self.grades[place], 0)
        return out

    def prefix(self, h: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        keep = len(h) - -(-percent * len(h) // 100) + SHARED
        g = self.grade(h)
        if g.any():
            order = np.argsort(g, kind="stable")[:keep]
            return h[order], g[order]
        return h[:keep], g[:keep]


def _text_keys(text: str = "text"):
    """Two 64-bit hashes of different seeds: together the key of a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def _described(docs: DataFrame) -> DataFrame:
    """Rows (id, n, k1, k2): a document's set size and text key; rows (h, c): a shingle that c texts of a stretch have. docs: id,
    text, k1, k2."""
    names = ["id", "n", "k1", "k2", "h", "c"]

    def often(held):
        held.sort()
        again = held[1:] == held[:-1]
        first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
        h = held[first]
        c = np.searchsorted(held, h, "right") - first
        none = pa.nulls(len(h), pa.int64())
        keep = pa.array(c >= OFTEN)
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(h.view(np.int64)), pa.array(c)], names).filter(keep)

    def run(batches):
        buffer, size, seen = np.zeros(STRETCH, np.uint64), 0, {}
        for b in slices(batches):
            keys = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            new = {k: i for i, k in enumerate(keys) if k not in seen}
            texts = b.column(1).take(pa.array(list(new.values()), pa.int64())).to_pylist()
            for k, h in zip(new, shingle_sets(texts), strict=True):
                seen[k] = len(h)
                for at in range(0, len(h), STRETCH):
                    part = h[at : at + STRETCH]
                    if size + len(part) > STRETCH:
                        yield often(buffer[:size])
                        size = 0
                    buffer[size : size + len(part)] = part
                    size += len(part)
            n = [seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names)
            if len(seen) > 200_000:
                seen = {}
        yield often(buffer[:size])
        del buffer, seen
        released()

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, h long, c long")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, grade) of the most common shingles, by shingle: at most COMMON of them, 9 bytes each. A grade is the log of a count."""
    grade = F.floor(F.log2("c")).cast("tinyint")
    counts = staged(rows.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).select("h", grade.alias("g")), "common")
    least, room = None, COMMON
    for g, n in sorted(((r[0], r[1]) for r in counts.groupBy("g").count().collect()), reverse=True):
        if n > room:
            break
        least, room = g, room - n
    if least is None:
        discard(counts)
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    t = counts.where(F.col("g") >= least).toArrow()
    discard(counts)
    h, g = t.column("h").to_numpy().view(np.uint64), t.column("g").to_numpy()
    order = np.argsort(h)
    return h[order], g[order]


def _meetings(docs: DataFrame, common: np.ndarray, grades: np.ndarray) -> DataFrame:
    """(x, y, h, members): the texts (k1) of every prefix shingle that two texts of neighbouring bands of sizes have. x and y are a
    key of the members, so that meetings of the very same texts are alike; a large or hot meeting comes in parts, by its shingle h."""

    def prefixes(batches):
        order, seen = _Order(common, grades), set()
        for b in slices(batches):
            keys = b.column(1).to_pylist()
            new = {k: i for i, k in enumerate(keys) if k not in seen}
            if len(seen) > 1_000_000:
                seen = set()
            seen.update(new)
            sets = shingle_sets(b.column(0).take(pa.array(list(new.values()), pa.int64())).to_pylist())
            found = [order.prefix(h) for h in sets]
            if found:
                size = [len(h) for h, _ in found]
                k = np.repeat(np.fromiter(new, np.int64, len(new)), size)
                band = np.repeat(np.floor(np.log(np.maximum([len(h) for h in sets], 1)) / np.log(4 / 3) + 1e-9).astype(np.int8), size)
                hot = np.concatenate([g for _, g in found]) >= HOT_GRADE
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found]).view(np.int64)), pa.array(k), pa.array(band), pa.array(np.where(hot, 1 + (k & (SALTS - 1)), 0).astype(np.int8))], ["h", "k1", "band", "part"])

    small = int(np.ceil(np.log(4 * SHARED / 3) / np.log(4 / 3)))

    def alike(batches):
        """A row for each run of rows of one h whose bands have no gap. The last run of a batch waits for the next batch; what a run
        has beyond LARGE goes out in parts."""
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy() if held is None else np.concatenate([held[i], b.column(i).to_numpy()]) for i in range(4)]
            if not len(cols[0]):
                continue
            h, k, band, _ = cols
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            h, k, band, part = (c[new] for c in cols)
            # sets so small that they may share less than SHARED go the way of large meetings, and stay
            part = np.maximum(part, (band < small).astype(np.int8))
            cut = np.flatnonzero((h[1:] != h[:-1]) | (band[1:] - band[:-1] > 1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            if len(h) - last > LARGE:
                part[last:] = 1
                yield from given(h, k, part, np.append(cut, len(h)))
                # one row stays, to go on with the run; it is counted once in the tile
                held = [c[-1:] for c in (h, k, band, part)]
            else:
                yield from given(h[:last], k[:last], part[:last], cut)
                held = [c[last:] for c in (h, k, band, part)]
        if held is not None:
            yield from given(held[0], held[1], held[3], np.array([len(held[0])]))

    def given(h, k, part, ends):
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        size = ends - first
        if not len(h):
            return
        large = np.maximum.reduceat(part, first) > 0
        keep = large | (size > 1)
        mixed = _mixed(_mixed(k.view(np.uint64)) ^ _M2)
        x, y = (np.bitwise_xor.reduceat(v, first)[keep].view(np.int64) for v in (mixed, _mixed(mixed * _M2)))
        rows = np.repeat(keep, size)
        offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
        pure = pa.array(~large[keep])
        none = pa.nulls(len(x), pa.int64())
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[rows]))
        yield pa.RecordBatch.from_arrays([pc.if_else(pure, pa.array(x), none), pc.if_else(pure, pa.array(y), none), pc.if_else(pure, none, pa.array(h[first][keep])), members], ["x", "y", "h", "members"])

    rows = docs.select("text", "k1").mapInArrow(prefixes, "h long, k1 long, band byte, part byte")
    parts = max(1, shuffle_parts(docs.sparkSession))
    return rows.repartition(parts, "h", "part").sortWithinPartitions("h", "band", "k1").mapInArrow(alike, "x long, y long, h long, members array<long>")


def _tiles(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tile, node, n): the nodes of every meeting, each set of nodes once and cut by bands of sizes. A band reaches 4/3 from its
    lower end, so a node is in the tile of its own band and, as the larger of a pair, in that of the band below."""
    same = shared.where("h is null").groupBy("x", "y").agg(F.count("*").alias("times"), F.first("members").alias("members"))
    once = same.where((F.size("members") > 2) | (F.col("times") >= SHARED)).select(F.xxhash64("x", "y").alias("h"), F.explode("members").alias("k1"))
    parts = shared.where("h is not null").select("h", F.explode("members").alias("k1")).distinct()
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rows = once.union(parts).join(nodes.select("k1", "node", "n"), "k1").withColumn("own", band).select("h", "node", "n", "own", F.explode(F.array("own", F.col("own") - 1)).alias("band"))
    rows = staged(rows, "members")
    full = rows.groupBy("h", "band").agg(F.count("*").alias("m"), F.max(F.col("own") == F.col("band")).alias("some")).where("m > 1 and some").drop("m", "some")
    out = staged(rows.join(full, ["h", "band"]).select(F.xxhash64("h", "band").alias("tile"), "node", "n"), "tiles")
    discard(rows)
    return out


def _of_texts(docs: DataFrame, nodes: DataFrame, what) -> DataFrame:
    """(node, data): what(set) of the nodes (k1, k2, node), from one of each node's rows."""
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes

    def run(batches):
        seen = set()
        for b in slices(batches):
            new = {k: i for i, k in enumerate(b.column(0).to_pylist()) if k not in seen}
            seen.update(new)
            rows = list(new.values())
            for at in range(0, len(rows), 256):
                few = pa.array(rows[at : at + 256], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(few), pa.array([what(h) for h in shingle_sets(b.column(1).take(few).to_pylist())], pa.binary())], ["node", "data"])

    return docs.join(nodes, ["k1", "k2"]).select("node", "text").mapInArrow(run, "node long, data binary").dropDuplicates(["node"])


def _groups(batches, keys: int):
    """Runs of rows with equal first `keys` columns, each as a list of numpy arrays or, for binary and list columns, lists. The rows come sorted by them."""
    cols = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_pylist() if pa.types.is_binary(b.column(i).type) or pa.types.is_list(b.column(i).type) else b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        cols = new if cols is None else [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(cols, new, strict=True)]
        cut = np.flatnonzero(np.stack([c[1:] != c[:-1] for c in cols[:keys]]).any(0)) + 1
        at = 0
        for to in cut.tolist():
            yield [c[at:to] for c in cols]
            at = to
        cols = [c[at:] for c in cols]
    if cols is not None:
        yield cols
    released()


def _before(lists: list[list[int]], tile: int) -> np.ndarray:
    """For each list of tiles a row of bits, one for each tile below `tile` that is in any list."""
    flat = np.concatenate([np.array(x, np.int64) for x in lists])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    low = flat < tile
    known, at = np.unique(flat[low], return_inverse=True)
    out = np.zeros((len(lists), len(known) // 8 + 1), np.uint8)
    np.bitwise_or.at(out, (row[low], at >> 3), (1 << (at & 7)).astype(np.uint8))
    return out


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _blocks(count, n):
    return F.ceil(F.greatest(count / F.lit(BLOCK), count * n / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")


def _led(tiles: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): a node and its leader, at most one for each node. tiles: tile, node, n, comp; one node of a component of a tile
    takes part, in LED of its tiles. A leader is the first node by chance order, then the first that isn't like enough to a
    leader, and so on."""
    few = tiles.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.slice(F.sort_array(F.collect_list("tile")), 1, LED).alias("tiles"))
    tiles = few.select(F.explode("tiles").alias("tile"), "node", "n", "comp")
    heads = tiles.groupBy("tile", "comp").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("h")).select("tile", "h.node", "h.n")
    size = heads.groupBy("tile").agg(_blocks(F.count("*"), F.max("n")).alias("blocks"))
    rows = heads.join(size, "tile").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")).join(sigs, "node")
    rows = rows.select("tile", "block", F.xxhash64("node").alias("chance"), "node", "n", "sig").repartition(max(1, shuffle_parts(tiles.sparkSession)), "tile", "block").sortWithinPartitions("tile", "block", "chance")

    def run(batches):
        for _, _, _, node, n, sig in _groups(batches, 2):
            s = folded(sig)
            own, free, found = ones(s), np.ones(len(node), bool), []
            for i in range(len(node) - 1):
                if free[i]:
                    j = i + 1 + np.flatnonzero(free[i + 1 :])
                    both = ones(s[i] & s[j])
                    j = j[linked(most_shared(both, own[i], own[j], n[i], n[j]), n[i], n[j]) & (both >= OFFER * (own[i] + own[j] - both))]
                    free[j] = False
                    found.append((node[j], np.full(len(j), node[i])))
            yield _pairs(found)

    pairs = rows.mapInArrow(run, "a long, b long")
    return pairs.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))


def _verified(pairs: DataFrame, sets) -> DataFrame:
    """The pairs (node a, leader b) whose sets overlap enough: a leader's set comes once for every BLOCK of its pairs."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    whole = sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    led = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("led"), F.col("a").alias("node")).join(whole, "node")
    leaders = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("led"), F.col("b").alias("node")).join(whole, "node")
    cols = ["b", "part", "led", "node", "set"]
    rows = led.select(*cols).unionByName(leaders.select(*cols)).repartition(max(1, shuffle_parts(pairs.sparkSession)), "b", "part").sortWithinPartitions("b", "part", "led")

    def run(batches):
        leader, its = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for b, led, node, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                x = np.frombuffer(data, np.uint64)
                if not led:
                    leader, its = b, x
                elif b == leader and linked(len(np.intersect1d(x, its, assume_unique=True)), len(x), len(its)):
                    found.append((np.array([node]), np.array([b])))
            yield _pairs(found)

    links = staged(rows.mapInArrow(run, "a long, b long"), "links")
    discard(whole)
    return links


def _last(tiles: DataFrame, sigs: DataFrame, sets, every: bool) -> DataFrame:
    """Links (a, b) between the components of a tile: all of them if `every`, else as many as join what is linked. tiles: tile,
    node, n, comp.

    Only nodes outside a tile's largest component have to be compared with all others, so a tile is cut into blocks of these and
    blocks of all. The first pass keeps the nodes that sizes and bit counts leave a partner with which they are in no tile of a
    lower number (so a pair is compared once, not in each of its tiles); only their sets go to the second.
    """
    comps = tiles.groupBy("tile", "comp").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    about = comps.groupBy("tile").agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("major"), F.max("n").alias("most")).where("m > major.k")
    about = about.select("tile", F.col("major.comp").alias("major"), _blocks(F.col("m") - F.col("major.k"), F.col("most")).alias("blocks"), _blocks(F.col("m"), F.col("most")).alias("chunks"))
    rows = tiles.join(about, "tile").withColumn("minor", F.col("comp") != F.col("major"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")).cast("int"))
    cell = lambda b, c: F.struct(b.cast("int").alias("b"), c.cast("int").alias("c"))
    right = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(b, F.col("chunk")))
    left = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: cell(F.col("mine"), c))
    rows = rows.withColumn("cell", F.explode(F.array_distinct(F.when(F.col("minor"), F.concat(left, right)).otherwise(right))))
    rows = rows.select("tile", "cell.b", "cell.c", "node", "n", "comp", "minor", (F.col("minor") & (F.col("mine") == F.col("cell.b"))).alias("left"), (F.col("chunk") == F.col("cell.c")).alias("right"))
    keys, parts = ["tile", "b", "c"], max(1, shuffle_parts(tiles.sparkSession))
    dealt = lambda df: df.repartition(parts, *keys).sortWithinPartitions(*keys)
    names = ["tile", "b", "c", "node", "n", "comp", "minor", "left", "right"]
    schema = "tile long, b int, c int, node long, n long, comp long, minor boolean, left boolean, right boolean"

    def partners(i, node, n, comp, minor, at, s, own):
        """Of the right rows `at`, those that row i has to be compared with: each pair in one cell and one direction."""
        j = at[(comp[at] != comp[i]) & (~minor[at] | (node[i] < node[at]))]
        j = j[linked(np.minimum(n[i], n[j]), n[i], n[j])]
        return j[linked(most_shared(ones(s[i] & s[j]), own[i], own[j], n[i], n[j]), n[i], n[j])]

    def bound(batches):
        for g in _groups(batches, 3):
            tile, _, _, node, n, comp, minor, left, right, sig, lists = g
            s, before = folded(sig), _before(lists, int(tile[0]))
            own, at, keep = ones(s), np.flatnonzero(right), np.zeros(len(node), bool)
            for i in np.flatnonzero(left).tolist():
                j = partners(i, node, n, comp, minor, at, s, own)
                j = j[~(before[i] & before[j]).any(-1)]
                keep[j] = True
                keep[i] |= len(j) > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in g[:-2]], names)

    def exact(batches):
        for g in _groups(batches, 3):
            *_, node, n, comp, minor, left, right, data = g
            sets = [np.frombuffer(x, np.uint64) for x in data]
            s = folded([signature(x) for x in sets])
            own, at, part = ones(s), np.flatnonzero(right), comp.copy()
            # the tile's shingles as small numbers, so that a set's are marked in a table
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            mark, found = np.zeros(int(flat.max()) + 1, bool), []
            for i in np.flatnonzero(left).tolist():
                j = partners(i, node, n, comp if every else part, minor, at, s, own)
                if not len(j):
                    continue
                mark[flat[ends[i] - n[i] : ends[i]]] = True
                shared = np.array([np.count_nonzero(mark[flat[ends[k] - n[k] : ends[k]]]) for k in j.tolist()])
                mark[flat[ends[i] - n[i] : ends[i]]] = False
                j = j[linked(shared, n[i], n[j])]
                if not every:
                    j = j[np.unique(part[j], return_index=True)[1]]
                    part[np.isin(part, part[j])] = part[i]
                found.append((np.full(len(j), node[i]), node[j]))
            if found:
                yield _pairs(found)

    about = sigs.join(tiles.groupBy("node").agg(F.collect_list("tile").alias("tiles")), "node")
    open_ = staged(dealt(rows.join(about, "node").select(*names, "sig", "tiles")).mapInArrow(bound, schema), "open")
    whole = sets(open_.select("node").distinct())
    links = staged(dealt(open_.join(whole, "node").select(*names, "set")).mapInArrow(exact, "a long, b long"), "links")
    discard(open_, whole)
    return links.distinct() if every else links


class _Join:
    """The staged tables of one join: member (id, n, k1, k2), nodes (k1, k2, node, low, copies, n), tiles and sigs."""

    def __init__(self, docs: DataFrame, text: str, id_col: str):
        docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), *_text_keys(text))
        rows = staged(_described(docs), "described")
        common, grades = _common(rows)
        self.member = rows.where("h is null").select("id", "n", "k1", "k2")
        self.rows = rows
        # texts without words have no node
        nodes = self.member.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("n"))
        self.nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        shared = staged(_meetings(docs, common, grades), "shared")
        self.tiles = _tiles(shared, self.nodes)
        live = staged(self.nodes.join(self.tiles.select("node").distinct(), "node").select("k1", "k2", "node"), "live")
        self.sigs = staged(_of_texts(docs, live, signature).withColumnRenamed("data", "sig"), "signatures")
        self.docs = docs
        discard(shared, live)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of some nodes (node): only those that passed the bit counts are asked for."""
        some = staged(self.nodes.join(nodes, "node").select("k1", "k2", "node"), "some")
        out = staged(_of_texts(self.docs, some, np.ndarray.tobytes).withColumnRenamed("data", "set"), "sets")
        discard(some)
        return out

    def inside(self, links: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The tiles with each node's component, without those that are in one component as a whole; and the components."""
        comps = None if links is None else staged(components(links), "components")
        if comps is None:
            return self.tiles.withColumn("comp", F.col("node")), None
        rows = self.tiles.join(comps, F.col("node") == F.col("id"), "left").select("tile", "node", "n", F.coalesce("component", "node").alias("comp"))
        open_ = rows.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tile")
        return rows.join(open_, "tile", "left_semi"), comps


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, a row per document; links at a Jaccard similarity of 75 % or more of 5-word shingles.

    component_id is the smallest doc_id of all rows that links lead to. Rows are judged by their texts: equal texts are one
    node, rows that share an id are judged apart, and rows without id are judged like others (their component is null only if
    no row of it has an id). Null texts and texts without words have 0 shingles and are their own component; a text of fewer words
    is one shingle. Other columns are not looked at. An empty table gives no rows.
    """
    j = _Join(docs, text, id_col)
    links = None
    for _ in range(ROUNDS):
        inside, comps = j.inside(links)
        inside = staged(inside, "inside")
        pairs = staged(_led(inside, j.sigs), "pairs")
        more = _verified(pairs, j.sets)
        links, before = more if links is None else staged(links.union(more), "links"), links
        discard(inside, pairs, *([] if before is None else [before, more]), *([] if comps is None else [comps]))
    inside, comps = j.inside(links)
    inside = staged(inside, "inside")
    last = _last(inside, j.sigs, j.sets, False)
    found = staged(components(links.union(last)), "components")
    discard(j.tiles, j.sigs, inside, comps, last, links)
    # the smallest id of each component, for its nodes and for copies; all other rows are their own component
    low = j.nodes.join(found, F.col("node") == F.col("id"), "left").select("k1", "k2", "low", "copies", F.coalesce("component", "node").alias("comp"), F.col("component").isNotNull().alias("on"))
    least = low.where("on").groupBy("comp").agg(F.min("low").alias("least"))
    changed = staged(low.where("on or copies > 1").join(least, "comp", "left").select("k1", "k2", F.when(F.col("on"), F.col("least")).otherwise(F.col("low")).alias("component"), F.lit(True).alias("many")), "changed")
    discard(found, j.nodes)
    out = j.member.join(F.broadcast(changed) if changed.count() <= BROADCAST_ROWS else changed, ["k1", "k2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("many"), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def similar_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link between two different texts as (a, b), a < b, and the rows of each text as (node, doc_id).
    Links are as many as there are; near_duplicates gives the groups without going through them all."""
    j = _Join(docs, text, id_col)
    pairs = _last(j.inside(None)[0], j.sigs, j.sets, True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    membership = j.member.join(j.nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("node", F.col("id").alias("doc_id"))
    return pairs, membership


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
