"""Token-ID / binary output: canonical length-limited Huffman files of token ids.

File format: a folder with one table ``blocks`` (Parquet) and one small table ``code``.

``code``   (id int, bits int): code lengths; codes are canonical, so lengths suffice.
``blocks`` (file int, block int, first_token long, first_doc long, n_tokens int,
           payload binary, checkpoints binary, doc_ids array<long>, doc_tokens
           array<long>, continued boolean)

A file holds a range of ascending document ids. A block holds up to ``BLOCK`` ids and is
decoded without any other; ``checkpoints`` are little-endian 32-bit bit offsets of every
``STEP``-th id, so decoding can start at each and runs over all of them in lockstep.
``continued``: the first document of the block began in an earlier block.

Null or empty texts are documents of the end id alone; null ids sort first; rows that
repeat an id are documents of their own, in any order; an empty table has empty files.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .store import Workspace, partitions
from .tokens import encoder

BLOCK = 1 << 16
STEP = 128
#: Code length limit: four bits above the 16 that 2**16 ids would need at least.
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for unused ids."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # of each level, which merged entries are leaves
    weights = leaf
    for _ in range(limit - 1):
        levels.append(weights)
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packages])
        weights = both[np.argsort(both, kind="stable")]
    levels.append(weights)
    # Take the first 2n - 2 entries of the last level, and open their packages downwards.
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for level in range(limit - 1, -1, -1):
        if level == 0:
            lengths[:take] += 1
            break
        below = levels[level - 1]
        packages = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        picked = np.argsort(np.concatenate([leaf, packages]), kind="stable")[:take]
        leaves = int((picked < n).sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order]
    if len(order):
        top = int(size.max())
        step = np.left_shift(np.uint64(1), (top - size).astype(np.uint64))
        codes[order] = ((np.cumsum(step, dtype=np.uint64) - step) >> (top - size).astype(np.uint64)).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block."""
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size, dtype=np.uint64)
    at = end - size
    word, off = at >> np.uint64(6), at & np.uint64(63)
    code = codes[ids].astype(np.uint64)
    room = np.uint64(64) - off
    fits = size <= room
    main = np.where(fits, code << np.where(fits, room - size, 0).astype(np.uint64), code >> np.where(fits, 0, size - room).astype(np.uint64))
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words = np.zeros(int(end[-1] + np.uint64(63)) // 64 + 1, np.uint64)
    words[word[first]] = np.add.reduceat(main, first)
    over = np.flatnonzero(~fits)
    words[word[over] + np.uint64(1)] += code[over] << (np.uint64(64) - (size[over] - room[over]))
    payload = words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8]
    return payload, at[::STEP].astype("<u4").tobytes()


class Decoder:
    """Table-driven: the next bits index a table of (id, code length)."""

    def __init__(self, lengths: np.ndarray):
        self.top = top = int(lengths.max()) if len(lengths) and lengths.max() else 1
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        times = np.left_shift(1, top - lengths[order])
        self.ids = np.zeros(1 << top, np.int32)
        self.size = np.ones(1 << top, np.int64)
        self.ids[: times.sum()] = np.repeat(order, times)
        self.size[: times.sum()] = np.repeat(lengths[order], times)

    def decode(self, blocks: list[tuple[bytes, bytes, int]]) -> np.ndarray:
        """ids of the blocks (payload, checkpoints, n), one after another, all in lockstep."""
        base, starts, left = 0, [], []
        for payload, marks, n in blocks:
            m = np.frombuffer(marks, "<u4").astype(np.int64)
            starts.append(m + base * 8)
            x = np.full(len(m), STEP, np.int64)
            if len(x):
                x[-1] = n - STEP * (len(m) - 1)
            left.append(x)
            base += len(payload)
        if not starts or not sum(map(len, starts)):
            return np.empty(0, np.int32)
        data = np.frombuffer(b"".join(b[0] for b in blocks) + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        at, left = np.concatenate(starts), np.concatenate(left)
        out = np.zeros((len(at), STEP), np.int32)
        mask, room = np.uint32((1 << self.top) - 1), 32 - self.top
        last = len(window) * 8 - 1
        for step in range(STEP):
            x = (window[at >> 3] >> (room - (at & 7)).astype(np.uint32)) & mask
            out[:, step] = self.ids[x]
            at += self.size[x]
            np.minimum(at, last, out=at)  # short last rows run on into bits that are not read
        return out[np.arange(STEP) < left[:, None]]


COUNTS = "id int, n long"
IDS = "file int, block int, first_token long, first_doc long, n_tokens int, ids binary, doc_ids array<bigint>, doc_tokens array<bigint>, continued boolean"
BLOCKS = "file int, block int, first_token long, first_doc long, n_tokens int, payload binary, checkpoints binary, doc_ids array<bigint>, doc_tokens array<bigint>, continued boolean"
SEGMENTS = "file int, doc long, block int, doc_id long, at long, n long, crc long"


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end), offsets + np.arange(n + 1)


def _cut(vocabulary: str, end: int):
    """Blocks of plain ids, 16 bits each where all ids fit."""

    def run(batches):
        from pyspark import TaskContext

        file, e = TaskContext.get().partitionId(), encoder(vocabulary)
        kind = "<u2" if e.vocabulary <= 1 << 16 else "<u4"
        held, held_docs = np.empty(0, np.int32), deque()  # docs: [id, tokens still to write, has begun]
        block = first = docs = 0

        def flush(n):
            nonlocal held, block, first, docs
            ids, held = held[:n], held[n:]
            of, sizes, continued, left, first_doc = [], [], held_docs[0][2], n, docs
            while left:
                d = held_docs[0]
                m = min(left, d[1])
                of.append(d[0])
                sizes.append(m)
                left -= m
                d[1] -= m
                d[2] = True
                if not d[1]:
                    held_docs.popleft()
                    docs += 1
            row = [file, block, first, first_doc, n, ids.astype(kind).tobytes(), of, sizes, continued]
            block, first = block + 1, first + n
            return row

        def batch(rows):
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in IDS.split(", ")])

        for b in batches:
            names = b.column(0).to_pylist()
            data, off = T.buffers(b.column(1))
            for lo, hi in T.slices(off, 4 * T.SLICE_BYTES):
                ids, at = with_end(*e.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), end)
                held = np.concatenate([held, ids])
                held_docs.extend([d, n, False] for d, n in zip(names[lo:hi], np.diff(at).tolist(), strict=True))
                rows = []
                while len(held) >= BLOCK:
                    rows.append(flush(BLOCK))
                if rows:
                    yield batch(rows)
        if len(held):
            yield batch([flush(len(held))])

    return run


def _block_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int32)


def _count(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw, n in zip(b.column("ids"), b.column("n_tokens"), strict=True):
            got = np.bincount(_block_ids(raw.as_py(), n.as_py()), minlength=len(total))
            got[: len(total)] += total
            total = got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches):
        codes = canonical_codes(lengths)
        for b in batches:
            out = [pack(_block_ids(raw.as_py(), n.as_py()), codes, lengths) for raw, n in zip(b.column("ids"), b.column("n_tokens"), strict=True)]
            made = {"payload": pa.array([x for x, _ in out], pa.binary()), "checkpoints": pa.array([x for _, x in out], pa.binary())}
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in names], names)

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, limit: int = LIMIT) -> None:
    """Encodes whole texts of (doc_id, text) to ``path`` in ascending doc_id order.

    Texts are range-shuffled and tokenized once; blocks of plain ids wait in the shared
    folder until the global counts have given the code.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ids")
    by = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(partitions(spark), by).sortWithinPartitions(by)
    plain = ws.save(rows.mapInArrow(_cut(vocabulary, end), IDS), "ids")
    counts = plain.select("ids", "n_tokens").mapInArrow(_count, COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([r["id"] for r in counts], default=0) + 1, np.int64)
    for r in counts:  # one row per id of the vocabulary at most
        total[r["id"]] = r["n"]
    lengths = code_lengths(total, limit)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    plain.mapInArrow(_encode(lengths), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    ws.close()


def _segments(lengths: np.ndarray):
    def run(batches):
        decoder = Decoder(lengths)
        for b in batches:
            rows = b.to_pydict()
            for lo in range(0, b.num_rows, 8):
                some = range(lo, min(lo + 8, b.num_rows))
                ids = decoder.decode([(rows["payload"][i], rows["checkpoints"][i], rows["n_tokens"][i]) for i in some]).astype("<u4")
                out, at = [], 0
                for i in some:
                    inside = 0
                    for k, (d, n) in enumerate(zip(rows["doc_ids"][i], rows["doc_tokens"][i], strict=True)):
                        out.append((rows["file"][i], rows["first_doc"][i] + k, rows["block"][i], d, rows["first_token"][i] + inside, n, zlib.crc32(ids[at + inside : at + inside + n])))
                        inside += n
                    at += inside
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (0, 2) else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], [x.split()[0] for x in SEGMENTS.split(", ")])

    return run


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/code").collect()
    out = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["bits"]
    return out


def _ids(lengths: np.ndarray):
    def run(batches):
        decoder = Decoder(lengths)
        for b in batches:
            rows = b.to_pydict()
            for i in range(b.num_rows):
                ids = decoder.decode([(rows["payload"][i], rows["checkpoints"][i], rows["n_tokens"][i])])
                cuts = np.cumsum(rows["doc_tokens"][i])[:-1]
                n = len(rows["doc_ids"][i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows["file"][i]] * n, pa.int32()), pa.array([rows["first_doc"][i] + k for k in range(n)], pa.int64()), pa.array([rows["block"][i]] * n, pa.int32()), pa.array(rows["doc_ids"][i], pa.int64()), pa.array([x.tolist() for x in np.split(ids, cuts)], pa.list_(pa.int32()))],
                    ["file", "doc", "block", "doc_id", "ids"],
                )

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, block, doc_id, ids): the ids of each document's part in each block."""
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_ids(read_code(spark, path)), "file int, doc long, block int, doc_id long, ids array<int>")


def crc_join(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings joined, from theirs and the second's size in bytes."""

    def times(matrix, x):
        out, i = 0, 0
        while x:
            if x & 1:
                out ^= matrix[i]
            x, i = x >> 1, i + 1
        return out

    zero = [0xEDB88320, *(1 << i for i in range(31))]  # appends one zero bit
    for _ in range(3):
        zero = [times(zero, x) for x in zero]
    while size:
        if size & 1:
            first = times(zero, first)
        zero, size = [times(zero, x) for x in zero], size >> 1
    return first ^ second


def _joined(batches):
    for b in batches:
        parts = b.column("parts")
        n, flat = parts.value_lengths().to_numpy(zero_copy_only=False), parts.flatten()
        first = np.cumsum(n) - n
        size, crc = flat.field("n").to_numpy(), flat.field("crc").to_numpy()
        out = crc[first].copy()
        for i in np.flatnonzero(n > 1).tolist():  # documents that cross blocks
            for j in range(first[i] + 1, first[i] + n[i]):
                out[i] = crc_join(int(out[i]), int(crc[j]), 4 * int(size[j]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the files.

    Parts of documents that cross blocks are joined by their checksums, so no task holds
    more than a block's ids.
    """
    parts = spark.read.parquet(f"{path}/blocks").mapInArrow(_segments(read_code(spark, path)), SEGMENTS)
    files = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    before, run = [], 0
    for r in sorted(files, key=lambda r: r["file"]):  # one row per file
        before.append((r["file"], run))
        run += r["n"]
    begin = spark.createDataFrame(before, "file int, begin long")
    whole = (
        parts.groupBy("file", "doc")
        .agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
        .join(F.broadcast(begin), "file")
        .select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "parts")
    )
    return whole.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str, end: int = 0) -> DataFrame:
    """Writes the files to the shared folder and returns their ``digests``."""
    ws = Workspace(docs.sparkSession, "tokens")
    write(docs, ws.path("files"), vocabulary, end)
    return digests(docs.sparkSession, ws.path("files"))
