"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's segments are words of 23 bits for the perfect binary Golay code. A word's keys are
the indices of the codewords nearest to itself and to its 23 neighbours: one key, or six. Words
that differ in two bits or fewer share a word at one bit from both, hence a key. Fingerprints meet
under keys joined from segments such that pigeonhole finds every pair (`radius_keys`), or from a
segment and a min-hash anchor (`anchored_keys`). Fingerprints of one key are compared inside a
task, and only a star of each connected part is emitted, never all pairs. The pipeline's stage takes
fingerprints for candidates only and keeps a link if the two texts' shingles say so (`alike`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discarded, joined, released, rows_of, written
from .components import components

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the (23, 12, 7) code.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most members of a key that one task holds; a larger key is compared in pairs of blocks.
BLOCK = 65_536
#: Members, and bytes of their sets, of a block of a group whose parts are compared with each other.
PART_ROWS, PART_BYTES = 2_048, 32 << 20
#: Runs up to this length are compared row by row for the whole batch at once.
SHORT = 12


#: 128 bits; at Jaccard 0.8 two sets' cosine is 2 * 0.8 / 1.8, an angle of 0.1515 pi, so of 19 bits with a deviation
#: of 4. The radius is four deviations more, since it only finds candidates.
NEAR_WORDS, NEAR_ANCHORS, NEAR_RADIUS = 2, 24, 36
#: Shingles are of so many words; texts are near duplicates from this Jaccard similarity on, as a fraction.
NEAR_SHINGLE, NEAR_LEAST = 5, (4, 5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    high = np.array([rest(i << 11) for i in range(4096)], np.int32)
    leader = np.zeros(2048, np.int64)
    for n in range(4):
        for bits in combinations(range(23), n):
            error = sum(1 << b for b in bits)
            leader[rest(error)] = error
    ones = [(1 << i, rest(1 << i)) for i in range(23)]
    masks = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        near = sorted({int(leader[s]), *(e ^ int(leader[s ^ r]) for e, r in ones)}, key=lambda m: (m != leader[s], m))
        # masks that lead to one codeword differ by less than its minimum distance, so they are equal
        masks[s, : len(near)] = near
    return high, masks


_HIGH, _MASKS = _tables()


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six 12-bit codeword indices and which of them count (one or six)."""
    words = words.astype(np.int64)
    masks = _MASKS[_HIGH[words >> 11] ^ (words & 2047)]
    return ((words[:, None] ^ masks) >> 11) & 4095, masks >= 0


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def radius_keys(fps: np.ndarray, _anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): any two 64-bit fingerprints at 4 bits or fewer share a key.

    Either one of the three segments is equal and another differs in at most 2 bits, or all three
    differ in 1 or 2 bits.
    """
    segments = _segments(fps[:, 0])
    keys = [golay_keys(s) for s in segments]
    rows, found = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                index, valid = keys[j]
                row, col = np.nonzero(valid)
                rows.append(row)
                found.append(((3 * i + j) << 36) | (segments[i][row] << 12) | index[row, col])
    (a, va), (b, vb), (c, vc) = keys
    valid = va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :]
    row, x, y, z = np.nonzero(valid)
    rows.append(row)
    found.append((15 << 36) | (a[row, x] << 24) | (b[row, y] << 12) | c[row, z])
    return np.concatenate(rows), np.concatenate(found)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchored_keys(fps: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints that share an anchor and differ in 2 bits or fewer of any one segment share a key."""
    rows, found = [], []
    for w in range(fps.shape[1]):
        for s, segment in enumerate(_segments(fps[:, w])):
            index, valid = golay_keys(segment)
            row, col = np.nonzero(valid)
            part = (np.uint64((w * 3 + s + 1) << 12) + index[row, col].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(anchors.shape[1]):
                rows.append(row)
                found.append(_mixed(anchors[row, k] + part).view(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def near_keys(fps: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): `anchored_keys` of the first three anchors, and one key for each three anchors in turn."""
    row, key = anchored_keys(fps[:, :NEAR_WORDS], anchors[:, :3])
    rows, found = [row], [key]
    for k in range(0, anchors.shape[1], 3):
        a, b, c = (anchors[:, k + i] for i in range(3))
        rows.append(np.arange(len(anchors)))
        found.append(_mixed(_mixed(_mixed(a + np.uint64(k + 1)) + b) + c).view(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def shingle_hashes(text: str | None, n: int, block: int = 200_000) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's n-word shingles, in blocks; of all its words if these are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        yield np.array([digest(b" ".join(words), 42)], np.uint64)
        return
    for at in range(0, len(words) - n + 1, block):
        some = words[at : at + block + n - 1]
        joined = b" ".join(some)
        size = np.fromiter(map(len, some), np.int64, len(some))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size)[: len(some) - n + 1].tolist(), end[n - 1 :].tolist()
        yield np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)


def fingerprint_texts(texts: list[str | None], n: int, words: int = 1, anchors: int = 0, shingles: Callable = shingle_hashes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints [text, words] and min-hash anchors [text, anchors] as uint64; zeros without words.

    A bit is 1 if set in over half of the hashes that `shingles` gives, by default with repeats. The
    first word takes the hashes as they are, further words and anchors mixed ones.
    """
    count, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64 * words), np.int64)
    low = np.full((len(texts), anchors), np.iinfo(np.uint64).max, np.uint64)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        rows, h = np.array([i for i, _ in held]), np.concatenate([x for _, x in held])
        size = np.array([len(x) for _, x in held])
        starts = np.cumsum(size) - size
        for w in range(words):
            x = h if not w else _mixed(h + np.uint64(w))
            ones = np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64)
            np.add.at(bits[:, 64 * w : 64 * w + 64], rows, np.add.reduceat(ones, starts, axis=0, dtype=np.int64))
        for k in range(anchors):
            np.minimum.at(low[:, k], rows, np.minimum.reduceat(_mixed(h + np.uint64(1000 + k)), starts))
        np.add.at(count, rows, size)
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in shingles(text, n):
            held.append((i, h))
            waiting += len(h)
            if waiting >= 200_000:
                flush()
                waiting = 0
    flush()
    packed = np.packbits(bits * 2 > count[:, None], axis=1).reshape(len(texts), words, 8)
    return packed.view(">u8").reshape(len(texts), words).astype(np.uint64), low


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct hashes of the text's shingles in order."""
    parts = list(shingle_hashes(text, n))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())


def fingerprints(docs: DataFrame, n: int, words: int = 1, anchors: int = 0) -> DataFrame:
    """(doc_id, f0.., m0..) of whole texts, a row for each row of docs; null texts have no words, and zeros, as empty ones. Other columns are not looked at."""

    def run(batches):
        released()
        for part, (texts,) in rows_of(batches, "text"):
            fps, low = fingerprint_texts(texts, n, words, anchors)
            cols = [*fps.T, *low.T]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols)], names=names)

    names = ["doc_id", *(f"f{i}" for i in range(words)), *(f"m{i}" for i in range(anchors))]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def stars(nodes: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node) over the connected parts of the members of one key."""
    left, out = np.argsort(nodes, kind="stable"), []
    while len(left) > 1:
        root, front, left = nodes[left[0]], [left[0]], left[1:]
        while front and len(left):
            near = _apart(fps[left], fps[front.pop()]) <= radius
            if near.any():
                new, left = left[near], left[~near]
                out += [(int(x), int(root)) for x in nodes[new]]
                front += new.tolist()
    return out


def trees(nodes: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, node) within the radius that span the connected parts of one key, from the member nearest to the most common bits."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)
    left, out = np.lexsort((nodes, (bits != (bits.sum(0) * 2 > len(bits))).sum(1))), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop(0)
            near = _apart(fps[left], fps[at]) <= radius
            if near.any():
                new, left = left[near], left[~near]
                out += [(int(x), int(nodes[at])) for x in nodes[new]]
                front += new.tolist()
    return out


def _linked(words: int, radius: int, block: int, spanning: Callable = stars) -> Callable:
    """mapInArrow over rows sorted by key: edges (a, b), and the rows (a, key, block, f..) of keys beyond `block` members.

    Short runs give all pairs within the radius, longer ones what `spanning` makes of them, with block 1.
    """

    def edges(a: list[int], b: list[int], long: bool = False) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        mark = pa.array([1] * len(a), pa.int64()) if long else none
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, mark, *[none] * words], names=names)

    def hot(key: int, nodes: np.ndarray, fps: np.ndarray, at: int) -> pa.RecordBatch:
        cols = [np.full(len(nodes), key), (at + np.arange(len(nodes))) // block, *(np.ascontiguousarray(c).view(np.int64) for c in fps.T)]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), *map(pa.array, cols)], names=names)

    names = ["a", "b", "key", "block", *(f"f{i}" for i in range(words))]

    def whole(keys, nodes, fps):
        """All runs of these rows, which hold no part of a run."""
        if not len(keys):
            return
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        in_short = np.repeat(size <= SHORT, size)
        for step in range(1, int(min(SHORT, size.max()))):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & in_short[step:])
            at = at[_apart(fps[at], fps[at + step]) <= radius]
            if len(at):
                yield edges(nodes[at].tolist(), nodes[at + step].tolist())
        for i in np.flatnonzero(size > SHORT):
            s = slice(first[i], first[i] + size[i])
            if size[i] > block:
                yield hot(keys[first[i]], nodes[s], fps[s], 0)
            elif found := spanning(nodes[s], fps[s], radius):
                yield edges([a for a, _ in found], [b for _, b in found], True)

    def run(batches):
        released()
        keys, nodes, fps = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.uint64)
        hot_key, at = None, 0
        for batch in batches:
            k, n = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            f = np.stack([batch.column(f"f{i}").to_numpy() for i in range(words)], axis=1).view(np.uint64)
            if hot_key is not None:
                same = int(np.searchsorted(k, hot_key, "right"))
                if same:
                    yield hot(hot_key, n[:same], f[:same], at)
                    at += same
                k, n, f = k[same:], n[same:], f[same:]
                if not len(k):
                    continue
                hot_key = None
            keys, nodes, fps = np.concatenate([keys, k]), np.concatenate([nodes, n]), np.concatenate([fps, f])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            yield from whole(keys[:cut], nodes[:cut], fps[:cut])
            keys, nodes, fps = keys[cut:], nodes[cut:], fps[cut:]
            if len(keys) > block:
                hot_key, at = int(keys[0]), len(keys)
                yield hot(hot_key, nodes, fps, 0)
                keys, nodes, fps = keys[:0], nodes[:0], fps[:0]
        yield from whole(keys, nodes, fps)

    return run


def links(nodes: DataFrame, words: int, keys_of: Callable, radius: int, block: int = BLOCK, spanning: Callable = stars) -> DataFrame:
    """Edges (a, b, long) that connect what is connected among rows (node, f.., m..) that meet under a key and differ in `radius` bits or fewer; long: whether from a key with more than SHORT members."""
    fp_names = [f"f{i}" for i in range(words)]
    anchor_names = [c for c in nodes.columns if c[0] == "m" and c[1:].isdigit()]

    def keyed(batches):
        released()
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fps, low = (np.stack([part.column(c).to_numpy() for c in cols], axis=1).view(np.uint64) if cols else np.empty((part.num_rows, 0), np.uint64) for cols in (fp_names, anchor_names))
                rows, keys = keys_of(fps, low)
                node = part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows]), *(pa.array(np.ascontiguousarray(fps[rows, i]).view(np.int64)) for i in range(words))], names=["key", "node", *fp_names])

    fields = "".join(f", {x} long" for x in fp_names)
    # a node has some two hundred keys, so that small files of nodes would be few tasks of very many rows
    dealt = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    rows = dealt.mapInArrow(keyed, f"key long, node long{fields}")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "node")
    found = written(sorted_rows.mapInArrow(_linked(words, radius, block, spanning), f"a long, b long, key long, block long{fields}"), "simhash-links")
    edges, hot = found.where("b IS NOT NULL").selectExpr("a", "b", "block IS NOT NULL AS long"), found.where("b IS NULL")
    if not hot.isEmpty():
        edges = edges.union(_between_blocks(hot, fp_names, radius, spanning).withColumn("long", F.lit(True)))
    return edges


def _between_blocks(hot: DataFrame, fp_names: list[str], radius: int, spanning: Callable = stars) -> DataFrame:
    """Edges of keys with many members: each pair of blocks is one task, so none holds more than two blocks."""
    blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = F.expr("transform(sequence(0, last), x -> struct(least(x, block) AS i, greatest(x, block) AS j))")
    rows = hot.join(blocks, "key").select("key", F.col("a").alias("node"), *fp_names, F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "node", *fp_names)

    def compare(t: pa.Table) -> pa.Table:
        released()
        fps = np.stack([t.column(c).to_numpy() for c in fp_names], axis=1).view(np.uint64)
        found = spanning(t.column("node").to_numpy(), fps, radius)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def grouped(fps: DataFrame, words: int, keys_of: Callable, radius: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, f.., component_id) for rows (doc_id, f.., m..): component_id is the smallest doc_id reachable over links.

    Rows with a null doc_id link nothing and have a null component_id.
    """
    names = [f"f{i}" for i in range(words)]
    anchors = [c for c in fps.columns if c not in (*names, "doc_id")]
    first = fps.groupBy(*names).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *anchors))).alias("x"), F.count("*").alias("n"))
    nodes = written(first.select(F.col("x.doc_id").alias("node"), "n", *names, *(f"x.{c}" for c in anchors)), "simhash-nodes")
    found = components(links(nodes.where("node IS NOT NULL").drop("n"), words, keys_of, radius, block).select("a", "b"))
    label = nodes.join(found, "node", "left").select(*names, "n", F.coalesce("component", "node").alias("component_id"))
    out = joined(fps.select("doc_id", *names), label, names, fps.count())
    return out.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_digest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The query's rows: doc_id, fingerprint (hex), component_id over links of 4 bits or fewer, from 4-word shingles.

    Texts without words, null ones included, have fingerprint zero and are linked like any other.
    Equal rows stay and share a component; other columns of the input are not looked at.
    """
    fps = written(fingerprints(docs, 4), "simhash-fps")
    out = grouped(fps, 1, radius_keys, 4, block)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard_at_least(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = NEAR_LEAST) -> bool:
    """Whether two sets, sorted, are that similar; two empty ones are."""
    top, bottom = least
    if min(len(a), len(b)) * bottom < max(len(a), len(b)) * top:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * bottom >= (len(a) + len(b) - common) * top


def set_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, d0, d1, f0.., m0..) of the texts' sets of shingles, where a repeated shingle counts once; d0 and d1 are the set's digest."""
    names = ["doc_id", "d0", "d1", *(f"f{i}" for i in range(NEAR_WORDS)), *(f"m{i}" for i in range(NEAR_ANCHORS))]

    def run(batches):
        released()
        for part, (texts,) in rows_of(batches, "text"):
            digests = []

            def once(text, n):
                hashes = shingle_set(text, n)
                digests.append(set_digest(hashes))
                return [hashes] if len(hashes) else []

            fps, low = fingerprint_texts(texts, NEAR_SHINGLE, NEAR_WORDS, NEAR_ANCHORS, once)
            cols = [*np.array(digests, np.int64).reshape(-1, 2).T, *fps.T, *low.T]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) for nodes (node, doc_id, d0, d1): the set of shingles of that document's text with this digest."""

    def run(batches):
        released()
        for part, (texts,) in rows_of(batches, "text"):
            sets = [shingle_set(t, NEAR_SHINGLE) for t in texts]
            digests = np.array([set_digest(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, np.ascontiguousarray(digests.T)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "d0", "d1", "hashes"])

    some = docs.select(F.col("doc_id").cast("long"), "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = some.mapInArrow(run, "doc_id long, d0 long, d1 long, hashes binary")
    return sets.join(nodes, ["doc_id", "d0", "d1"]).select("node", "hashes").dropDuplicates(["node"])


def alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles have the least Jaccard similarity or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(shingle_sets(docs, nodes.select("node", "doc_id", "d0", "d1").join(ends, "node", "left_semi")), "near-sets")

    def run(batches):
        released()
        for part, sets in rows_of(batches, "x", "y"):
            keep = [jaccard_at_least(*(np.frombuffer(v, np.uint64) for v in pair)) for pair in zip(*sets, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").join(sets.toDF("a", "x"), "a")
    found = written(with_a.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")
    discarded(sets)
    return found


class Merged:
    """Labels of some members that are joined step by step."""

    def __init__(self, labels: np.ndarray):
        self.part = np.unique(labels, return_inverse=True)[1]

    def join(self, a: int, b: int) -> None:
        self.part[self.part == self.part[b]] = self.part[a]


def part_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, least: tuple[int, int] = NEAR_LEAST) -> list[tuple[int, int]]:
    """(node, node) of that Jaccard similarity or more which join parts of different labels, between `left` members and the others; among all, if all are left.

    Each left member's common shingles with all members are counted at once from lists of who has a
    shingle, so that the work is that of the shingles in common. At most as many links as members.
    """
    top, bottom = least
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    other = np.ones(len(sets), bool) if left.all() else ~left
    keep = other[owner]
    flat, owner = flat[keep], owner[keep]
    merged, out = Merged(labels), []
    for i in np.flatnonzero(left):
        first, last = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        spans = [owner[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a]
        common = np.bincount(np.concatenate(spans), minlength=len(sets)) if spans else np.zeros(len(sets), np.int64)
        like = other & (common * bottom >= (size + size[i] - common) * top)
        for j in np.flatnonzero(like & (merged.part != merged.part[i])):
            if merged.part[j] != merged.part[i]:
                merged.join(i, int(j))
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links_between_parts(members: DataFrame, sets: DataFrame, rows: int = PART_ROWS, size: int = PART_BYTES) -> DataFrame:
    """Links (a, b) that join different labels of a cluster, for members (node, cluster, label) with sets (node, hashes).

    All members outside a cluster's largest label are compared with all others, in pairs of blocks; a
    task holds two blocks and emits only links that join, so that no pairs are listed.
    """
    held = written(members.join(sets, "node").withColumn("bytes", F.octet_length("hashes").cast("long")), "near-members")
    per_label = held.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    split = per_label.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("top_bytes"), F.count("*").alias("labels")).where("labels > 1")
    count = lambda n, b: F.greatest(F.ceil(n / rows), F.ceil(b / size), F.lit(1)).cast("int")
    # the bytes of the others are at most all bytes
    split = split.select("cluster", "n", F.col("top.label").alias("largest"), count(F.col("n") - F.col("top.n"), F.col("bytes")).alias("few"), count(F.col("top.n"), F.col("bytes")).alias("many"))
    placed = joined(held, split, ["cluster"], held.count()).withColumn("few_side", F.col("label") != F.col("largest"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("few_side"), F.col("few")).otherwise(F.col("many"))).cast("int")
    # cells (i, j): block i of the others with block j of them, i <= j, or with block j - few of the largest label
    own = "transform(sequence(0, few - 1), x -> struct(least(x, at) AS i, greatest(x, at) AS j))"
    with_largest = "transform(sequence(0, many - 1), x -> struct(at AS i, few + x AS j))"
    from_largest = "transform(sequence(0, few - 1), x -> struct(x AS i, few + at AS j))"
    cells = F.expr(f"explode(IF(few_side, concat({own}, {with_largest}), {from_largest}))")
    rows_ = placed.withColumn("at", at).select("cluster", "node", "label", "hashes", "few_side", "at", cells.alias("cell")).select("cluster", "cell.i", "cell.j", "node", "label", "hashes", (F.col("few_side") & (F.col("at") == F.col("cell.i"))).alias("left"))

    def compare(t: pa.Table) -> pa.Table:
        released()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        left = t.column("left").to_numpy()
        found = part_links(t.column("node").to_numpy(), t.column("label").to_numpy(), sets, left) if left.any() else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    # dealt by cell, since a deal by cluster would do for the groups and bring all cells of a large cluster to one task
    dealt = rows_.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "i", "j")
    found = written(dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), "near-between")
    discarded(held)
    return found


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "long").groupBy("a", "b").agg(F.max("long").alias("long"))


def near_groups(docs: DataFrame, nodes: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, component) over verified links of nodes (node, doc_id, d0, d1, f0.., m0..).

    Keys with few members give all their candidate pairs, others the pairs that span them. Where one
    of those fails, all that they span is a cluster, whose parts are compared with each other member
    by member. So each candidate pair is connected or was looked at.
    """
    names = [f"f{i}" for i in range(NEAR_WORDS)]
    anchors = [f"m{i}" for i in range(NEAR_ANCHORS)]
    pairs = written(_pairs(links(nodes.select("node", *names, *anchors), NEAR_WORDS, near_keys, NEAR_RADIUS, block, spanning=trees)), "near-pairs")
    good = alike(pairs, docs, nodes)
    found = components(good)
    spanning = pairs.where("long")
    if not spanning.join(good, ["a", "b"], "left_anti").isEmpty():
        clusters = components(spanning).select("node", F.col("component").alias("cluster"))
        members = written(clusters.join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("label")), "near-clusters")
        mixed = members.groupBy("cluster").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("cluster")
        some = members.join(mixed, "cluster", "left_semi")
        sets = written(shingle_sets(docs, nodes.select("node", "doc_id", "d0", "d1").join(some, "node", "left_semi")), "near-sets")
        more = links_between_parts(some, sets, part_rows)
        found = components(good.union(more))
        discarded(members, sets, more)
    discarded(pairs, good)
    return found


def near_duplicates(docs: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """The input's rows and columns, of each group of near duplicates only that with the smallest doc_id.

    Near duplicates have a Jaccard similarity of 0.8 or more of their sets of five-word shingles,
    computed for all candidates that fingerprints and anchors find. Texts without words, null ones
    included, have equal, empty sets. Rows with a null doc_id all stay; of rows with equal doc_id
    and text one stays. Other columns stay whatever their names; no rows give none.
    """
    fps = written(set_fingerprints(docs), "near-fps")
    rest = [c for c in fps.columns if c not in ("doc_id", "d0", "d1")]
    first = fps.where("doc_id IS NOT NULL").groupBy("d0", "d1").agg(F.min(F.struct("doc_id", *rest)).alias("x"), F.count("*").alias("n"))
    nodes = written(first.select(F.monotonically_increasing_id().alias("node"), "d0", "d1", "n", "x.*"), "near-nodes")
    grouped_nodes = near_groups(docs, nodes, block, part_rows).join(nodes.select("node", "d0", "d1", "doc_id"), "node")
    smallest = grouped_nodes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    linked = grouped_nodes.join(smallest, "component").select("d0", "d1", F.col("smallest").alias("linked"))
    own = nodes.select("d0", "d1", "n", F.col("doc_id").alias("own")).join(linked, ["d0", "d1"], "left").select("d0", "d1", "n", F.coalesce("linked", "own").alias("first"))
    gone = joined(fps.select("doc_id", "d0", "d1"), own, ["d0", "d1"], fps.count()).where("doc_id <> first").select("doc_id").distinct()
    # the input's columns stay within one, so that none of theirs meets a name of these steps
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    kept = rows.where("id IS NOT NULL").join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    # the join has dealt rows out by id already; equal rows are told by the text's hash
    told = kept.withColumn("before", F.lag("text").over(Window.partitionBy("id").orderBy("text")))
    kept = told.where("before IS NULL OR before <> text").select("row")
    return kept.union(rows.where("id IS NULL").select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
