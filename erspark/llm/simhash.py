"""SimHash near-duplicate groups with BK-trees over shards of fingerprints.

Fingerprints have ``words`` 64-bit words; a bit is 1 if it is set in over half of the
shingles' hashes. Two link if at most ``radius`` bits differ.

Equal fingerprints are one tree node. A tree of all fingerprints has no size bound that
would allow a broadcast, so trees are built per shard: fingerprints that agree on a band
of bits. With ``radius + 1`` disjoint bands every link lies in a shard (some band has no
differing bit); a shard over ``MAX_SHARD`` is split by the same argument on its other
bits. Where a similarity of shingle sets is asked for, fingerprints are those of the sets
(repeats of a shingle do not count) and only propose pairs: wide ones have a radius that
follows from it and many random bands, enough for the recall of ``bands_for``. A pair
links if the exact Jaccard of its shingle sets is at least the similarity. First the
forest of each shard is compared, then all other near pairs that these links leave in
different components.

In a BK-tree a child hangs at its distance to the parent, and a search follows only the
edges within the radius of the query's distance. Subtrees whose members are all linked
with the query already are skipped, so a large group of close copies costs neither the
square of its size in steps nor in rows: a shard returns a spanning forest of its links.

Null and empty texts have fingerprint zero and link like any other. Rows that repeat an
id or text are ordinary members. Null ids are members, but never name a component unless
it has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .store import Workspace, apart

SEED = 42
#: Distinct fingerprints of a shard beyond which it is split.
MAX_SHARD = 4096
#: Random bands of 8 bits that a large shard of wide fingerprints is split by: at a similarity of 0.8 a link
#: shares none of them with a chance under 1e-3.
SPLIT = 28
#: Rows that are linked in one go, unless one shard has more.
LINKED = 60_000


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of all shingles of ``shingle`` words; fewer words are one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    return np.array(hashes, np.uint64)


def fingerprint(words: list[bytes], shingle: int, size: int = 1) -> np.ndarray:
    """``size`` 64-bit words over all shingles of ``shingle`` words, repeats included."""
    return of_hashes(shingles(words, shingle), size)


def of_hashes(h: np.ndarray, size: int = 1) -> np.ndarray:
    if not len(h):
        return np.zeros(size, np.uint64)
    total = np.zeros(64 * size, np.int64)
    for a in range(0, len(h), 255):  # counts up to 255 fit a byte, which keeps the sums vectorised
        part = h[a : a + 255, None]
        if size > 1:
            part = np.concatenate([part, T.mix(part + (np.arange(1, size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])], 1)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h)).view(">u8").astype(np.uint64)


def _fingerprints(shingle: int, size: int):
    def run(batches):
        T.keep("", {})
        for b in batches:
            data, off = T.buffers(b.column("text"))
            raw = data.tobytes().translate(T.LOWER_BYTES)
            found = [fingerprint(raw[off[i] : off[i + 1]].split(), shingle, size).astype(">u8").tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return run


def _set_fingerprints(shingle: int, size: int):
    """Fingerprints of shingle sets, and a name of the set."""
    import xxhash

    def run(batches):
        T.keep("", {})
        for b in batches:
            data, off = T.buffers(b.column("text"))
            raw = data.tobytes().translate(T.LOWER_BYTES)
            found, node = [], []
            for i in range(len(off) - 1):
                h = np.unique(shingles(raw[off[i] : off[i + 1]].split(), shingle))
                found.append(of_hashes(h, size).astype(">u8").tobytes())
                node.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes()))
            node = pa.array(np.array(node, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), node, pa.array(found, pa.binary())], ["doc_id", "source", "node", "fp"])

    return run


def _sets(shingle: int):
    def run(batches):
        T.keep("", {})
        for b in batches:
            data, off = T.buffers(b.column("text"))
            raw = data.tobytes().translate(T.LOWER_BYTES)
            sets = [np.unique(shingles(raw[off[i] : off[i + 1]].split(), shingle)).astype("<u8").tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, as ascending arrays; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _alike(similarity: float):
    def run(batches):
        T.keep("", {})
        for b in batches:
            (x, at), (y, to) = T.buffers(b.column("x")), T.buffers(b.column("y"))
            x, y, at, to = np.frombuffer(x.tobytes(), "<u8"), np.frombuffer(y.tobytes(), "<u8"), at // 8, to // 8
            alike = [jaccard(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]) >= similarity for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return run


def even_bands(bits: int, n: int) -> list[np.ndarray]:
    """n disjoint bands, as bit numbers, that cover the bits."""
    return np.array_split(np.arange(bits), n)


def random_bands(bits: int, n: int, width: int, seed: int = SEED) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(n)]


def agreement(similarity: float) -> float:
    """Expected share of equal bits of two shingle sets of a Jaccard similarity."""
    return float(1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bands_for(similarity: float, n: int, bits: int, recall: float = 0.985) -> list[np.ndarray]:
    """Bands wide enough for n fingerprints and as many as the recall at the similarity asks for."""
    width = max(16, int(np.ceil(np.log2(max(n, 1) / 64))))
    share = agreement(similarity) ** width
    return random_bands(bits, int(np.ceil(np.log(1 - recall) / np.log(1 - share))), width)


def radius_for(similarity: float, bits: int, deviations: float = 3) -> int:
    """Differing bits that pairs of at least the similarity stay within, but for chance."""
    p = 1 - agreement(similarity)
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def _key(bits: np.ndarray, band: np.ndarray) -> np.ndarray:
    return bits[:, band].astype(np.int64) @ (1 << np.arange(len(band), dtype=np.int64))


def _as_words(column) -> np.ndarray:
    data, off = T.buffers(column)
    n = len(off) - 1
    return data.reshape(n, -1).view(">u8").astype(np.uint64) if n else np.empty((0, 1), np.uint64)


SHARDS = "shard long, key long, node long, fp binary"


def _deal(bands):
    def run(batches):
        T.keep("", {})
        for b in batches:
            bits = _bits(_as_words(b.column("fp")))
            for k, band in enumerate(bands):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), k)), pa.array(_key(bits, band)), b.column("node"), b.column("fp")], ["shard", "key", "node", "fp"])

    return run


def _split(bands, radius: int, exact: bool):
    """Deals rows of large shards again, by bits that their band left."""

    def run(batches):
        for b in batches:
            bits = _bits(_as_words(b.column("fp")))
            shard, key = b.column("shard").to_numpy(), b.column("key").to_numpy()
            for k in np.unique(shard).tolist():
                rows = np.flatnonzero(shard == k)
                free = np.setdiff1d(np.arange(bits.shape[1]), bands[k])
                finer = even_bands(len(free), radius + 1) if exact else random_bands(len(free), SPLIT, 8, k)
                for j, band in enumerate(finer):
                    name = T.mix(key[rows].astype(np.uint64) ^ np.uint64((k + 1) * 1_000_003 + j << 32)).view(np.int64)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(_key(bits[rows], free[band])), b.column("node").take(take), b.column("fp").take(take)], ["shard", "key", "node", "fp"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's connected component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def near(group: np.ndarray, fps: np.ndarray, radius: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, label): near pairs within each group, of all trees at once.

    group: ascending numbers of the shards that the fingerprints belong to. Without
    ``known`` the pairs span each component of near ones, which label names; with it, they
    are all near pairs that it labels differently.
    """
    n, span = len(group), 64 * fps.shape[1] + 1
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rest, label = np.arange(n), group
    near_a, near_b, levels = [], [], []
    # Insert level by level: the first of those that share a place becomes the node there.
    while len(rest):
        head = np.append(True, label[1:] != label[:-1])
        node = rest[head]
        levels.append(node)
        of = node[np.cumsum(head) - 1]
        rest, of = rest[~head], of[~head]
        d = distance(fps[rest], fps[of])
        close = d <= radius
        if known is None:
            near_a.append(of[close])
            near_b.append(rest[close])
        parent[rest], edge[rest] = of, d
        key = of * span + d
        order = np.argsort(key, kind="stable")
        rest, label = rest[order], key[order]
    z = np.empty(0, np.int64)
    near_a, near_b = np.concatenate([*near_a, z]), np.concatenate([*near_b, z])
    joined = labels(n, near_a, near_b) if known is None else known
    low, high = joined.copy(), joined.copy()
    for node in reversed(levels[1:]):
        np.minimum.at(low, parent[node], low[node])
        np.maximum.at(high, parent[node], high[node])
    child = np.flatnonzero(parent >= 0)
    keys = parent[child] * span + edge[child]
    order = np.argsort(keys, kind="stable")
    child, keys = child[order], keys[order]
    root = levels[0][np.cumsum(np.append(True, group[1:] != group[:-1])) - 1] if n else np.empty(0, np.int64)
    more_a, more_b = [], []
    for a in range(0, n, 50_000):
        q = np.arange(a, min(n, a + 50_000))
        at = root[q]
        while len(q):
            apart = (low[at] != joined[q]) | (high[at] != joined[q])
            q, at = q[apart], at[apart]
            d = distance(fps[q], fps[at])
            close = (d <= radius) & (joined[q] != joined[at])
            more_a.append(q[close])
            more_b.append(at[close])
            lo = np.searchsorted(keys, at * span + np.maximum(d - radius, 0))
            hi = np.searchsorted(keys, at * span + np.minimum(d + radius, span - 1), "right")
            times = hi - lo
            at = child[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())]
            q = np.repeat(q, times)
    more_a, more_b = np.concatenate([*more_a, z]), np.concatenate([*more_b, z])
    if known is not None:
        return more_a, more_b, known
    # One pair a member of those met on insertion, and of all others one for two components that those leave.
    _, first = np.unique(near_b, return_index=True)
    all_a, all_b = np.concatenate([near_a, more_a]), np.concatenate([near_b, more_b])
    part = labels(n, near_a[first], near_b[first])
    ends = np.sort(np.stack([part[all_a], part[all_b]]), axis=0)
    other = np.flatnonzero(ends[0] != ends[1])
    _, once = np.unique(ends[0][other] * (n + 1) + ends[1][other], return_index=True)
    other = other[once]
    return np.concatenate([near_a[first], all_a[other]]), np.concatenate([near_b[first], all_b[other]]), labels(n, all_a, all_b)


def link(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (root, member) of the links within each group."""
    joined = near(group, fps, radius)[2]
    member = np.flatnonzero(joined != np.arange(len(group)))
    return joined[member], member


def _link(radius: int, find=link, extra: tuple = ()):
    """Links shards that arrive sorted, many small ones together.

    ``find`` also gets the columns named in ``extra``.
    """

    def run(batches):
        T.keep("", {})
        held = None

        def done(names, keys, nodes, fps, *more):
            change = np.append(True, (names[1:] != names[:-1]) | (keys[1:] != keys[:-1]))
            group = np.cumsum(change)
            size = np.bincount(group)[group]
            some = size > 1
            a, b = find(group[some], fps[some], radius, *(x[some] for x in more))[:2]
            node = nodes[some]
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for x in batches:
            now = (x.column("shard").to_numpy(), x.column("key").to_numpy(), x.column("node").to_numpy(), _as_words(x.column("fp")), *(x.column(c).to_numpy() for c in extra))
            held = now if held is None else tuple(np.concatenate(p) for p in zip(held, now, strict=True))
            if len(held[0]) > LINKED:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield done(*(p[:cut] for p in held))
                    held = tuple(p[cut:] for p in held)
        if held is not None and len(held[0]):
            yield done(*held)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fp (binary, big-endian) of every whole text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle, words), "doc_id long, fp binary")


def set_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, source (a text's hash), node (its shingle set's), fp of that set."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("source"), "text")
    return rows.mapInArrow(_set_fingerprints(shingle, words), "doc_id long, source long, node long, fp binary")


def _shards(classes: DataFrame, bands, radius: int, exact: bool, ws: Workspace, name: str) -> DataFrame:
    """Rows (shard, key, node, fp) of fingerprints that agree on a band; large shards are split."""
    shards = ws.save(classes.mapInArrow(_deal(bands), SHARDS), name)
    large = ws.save(shards.groupBy("shard", "key").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_SHARD).select("shard", "key"), f"{name}-large")
    if not large.isEmpty():
        finer = shards.join(large, ["shard", "key"]).select("shard", "key", "node", "fp").mapInArrow(_split(bands, radius, exact), SHARDS)
        shards = shards.join(large, ["shard", "key"], "left_anti").select("shard", "key", "node", "fp").unionByName(finer)
    return shards


def _pairs(shards: DataFrame, *link_args) -> DataFrame:
    """Distinct (a, b), a < b, that the shards propose."""
    alone = shards.repartition("shard", "key").sortWithinPartitions("shard", "key", "node")
    found = alone.mapInArrow(_link(*link_args), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(docs: DataFrame, fps: DataFrame, shards: DataFrame, radius: int, bands, shingle: int, similarity: float, ws: Workspace) -> DataFrame | None:
    """(node, root) of the links of at least the similarity; None if there are none."""
    tried = ws.save(_pairs(shards, radius, near), "tried")
    ws.drop("shards")
    some = ws.save(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "proposed")
    # The sets of proposed texts only, one text of each.
    chosen = fps.join(apart(some), "node").groupBy("node").agg(F.min("source").alias("source"))
    texts = docs.select(F.xxhash64("text").alias("source"), "text").join(apart(chosen), "source").dropDuplicates(["source"])
    sets = ws.save(texts.select("node", "text").mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        x, y = (apart(sets.select(F.col("node").alias(n), F.col("shingles").alias(c))) for n, c in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long")

    edges = ws.save(alike(tried), "edges")
    named = components(edges, ws)
    root = F.col("node") if named is None else F.coalesce("root", "node")
    classes = fps.select("node", "fp").join(apart(some), "node").distinct()
    again = _shards(classes, bands, radius, False, ws, "shards-again")
    known = some.withColumn("root", F.col("node")) if named is None else some.join(named, "node", "left").select("node", root.alias("root"))
    again = again.join(apart(known), "node").select("shard", "key", "node", "fp", "root")
    rest = ws.save(_pairs(again, radius, near, ("root",)).join(tried, ["a", "b"], "left_anti"), "rest")
    more = ws.save(alike(rest), "more")
    if more.isEmpty():
        return named
    return components(edges.unionByName(more), Workspace(docs.sparkSession, "simhash-links"))


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach.

    With a similarity, links are pairs of shingle sets of at least that Jaccard, proposed
    by a radius and bands that follow from it and from the number of different sets;
    without, the radius is exact.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    bits = 64 * words
    if similarity is None:
        node = F.conv(F.hex("fp"), 16, -10).cast("long") if words == 1 else F.xxhash64("fp")
        fps = ws.save(fingerprints(docs, shingle, words).withColumn("node", node), "fingerprints")
        bands = even_bands(bits, radius + 1)
    else:
        fps = ws.save(set_fingerprints(docs, shingle, words), "fingerprints")
        radius, bands = radius_for(similarity, bits), bands_for(similarity, fps.agg(F.approx_count_distinct("node")).first()[0], bits)
    classes = fps.groupBy("node", "fp").agg(F.min("doc_id").alias("first"))
    shards = _shards(classes, bands, radius, similarity is None, ws, "shards")
    if similarity is None:
        edges = ws.save(_pairs(shards, radius), "edges")
        ws.drop("shards")
        named = components(edges, ws)
    else:
        named = _similar(docs, fps, shards, radius, bands, shingle, similarity, ws)
    if named is None:
        lowest = classes.select("node", "first")
    else:
        of = classes.select("node", "first").join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = of.join(apart(of.groupBy("root").agg(F.min("first").alias("lowest"))), "root").select("node", F.col("lowest").alias("first"))
    return fps.join(apart(lowest), "node").select("doc_id", "fp", F.col("first").alias("component_id"))
