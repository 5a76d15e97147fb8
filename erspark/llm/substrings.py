"""Repeated-substring removal by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.

A suffix array of every byte needs several times the corpus in space, so suffixes are
sampled: in each window of ``WINDOW`` bytes, the place of the smallest hash of ``GRAM``
bytes. Equal strings have their samples at equal places, so no repeat is missed: the
samples of a string that can be told from the string alone are a chain from the one of
its first window to the last whose ``WINDOW`` bytes still lie inside.

1. Initial buckets: suffixes with equal first ``WINDOW`` bytes (the q-gram; samples lie
   closer together than that, so the grams of a chain leave no byte out).
2. Refinement: a bucket is sorted on the distance to, and the bucket identifier of, the
   suffix at the next sampled offset. Identifiers that this gives stand for two samples,
   and the next round reads them at the offset of the second next one: updates are used
   again, so a round doubles the depth. Suffixes alone in their bucket are done, and
   rounds end when no chain of samples within ``LENGTH`` is longer.
3. The windows (strings of ``LENGTH``) with one chain are a run; its name is the bucket
   identifiers at both ends of the chain. All bytes of a run that stand elsewhere mean
   that all its windows repeat. Runs whose neighbours in the bucket differ, which lie
   where copies end, are compared window by window; one run stands for all equal ones.

Buckets are counted with partial aggregation, so a bucket may hold any share of the rows.
Grams and strings are compared by 64-bit identifiers, the final ones by two of them.
Texts are UTF-8 bytes; null is empty; rows with equal ids or texts count each; texts
shorter than ``LENGTH`` are never touched, nor is an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import Workspace, apart, partitions

LENGTH = 400
#: Bytes of which one suffix is sampled, and that name the first buckets.
WINDOW = 160
#: Bytes whose hash chooses the sample.
GRAM = 24
#: Parts of the texts, by key, whose runs are named one after the other: only one part's shuffle lies on disk.
PARTS = 2
#: Bytes of texts that are sampled, and whose runs are named, at once; their arrays stay in the processor's cache.
TOGETHER = 1 << 16
_POSITION = 22


def anchors(data: np.ndarray, prefix: np.ndarray, length: int, gram: int):
    """(place, first window, last window, hash) of the samples of one text's windows of ``length``."""
    n, w = len(data), length - gram + 1
    m = n - gram + 1
    at = np.arange(m)
    name = T.span_hash(prefix, at, at + gram)
    if n < 1 << _POSITION:
        order = (name >> np.uint64(_POSITION) << np.uint64(_POSITION)) | at.astype(np.uint64)
        least = sliding_min(order, w)
        place = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    else:  # longer texts in pieces that overlap by a window
        step, found = (1 << _POSITION) - length, []
        for a in range(0, m - w + 1, step):
            part = name[a : a + step + w - 1]
            least = sliding_min((part >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(part), dtype=np.uint64), w)
            found.append((least & np.uint64((1 << _POSITION) - 1)).astype(np.int64) + a)
        place = np.concatenate(found)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], first, last, name[place[first]]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by minima of twice as many each time."""
    least, have = x, 1
    while 2 * have <= w:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    n = len(x) - w + 1
    return np.minimum(least[:n], least[w - have :][:n])


#: shape: place, distance to the next sample (0: none), windows of text before the place and in all whose sample it is.
ANCHORS = "k1 long, k2 long, shape long, bucket long"
#: at: place, distance to the sample after the chain (0: none) and to the last one in it.
PAIRS = "k1 long, k2 long, at long, p long, gap long, q long"
#: span: first window, and how many more.
RUNS = "k1 long, k2 long, span long, core long, reach long"
WINDOWS = "k1 long, k2 long, start long, core long, name long"
_LOW = (1 << 11) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """A two-part key of the row's id and text; equal rows share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(7), text, "doc_id").alias("k2"))


def _batch(columns: list, schema: str):
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x).cast(kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _texts(batch):
    data, off = T.buffers(batch.column("text"))
    for i in np.flatnonzero(np.diff(off) > 0).tolist():
        yield i, data[off[i] : off[i + 1]]


def _samples(data: np.ndarray, length: int, window: int, gram: int):
    """(shape, bucket) of the sampled suffixes of one text that have ``window`` bytes."""
    prefix = T.prefix_hash(data)
    place, lo, hi, _ = anchors(data, prefix, window, gram)
    gap = np.diff(place, append=place[-1])
    some = place + window <= len(data)
    gap[:-1] *= some[1:]
    own = np.clip(np.minimum(hi, len(data) - length) - lo + 1, 0, None)
    shape = place << 33 | gap << 22 | (place - lo) << 11 | own
    return shape[some], T.span_hash(prefix, place[some], place[some] + window)


def samples(data: np.ndarray, off: np.ndarray, length: int, window: int, gram: int):
    """(text, shape, bucket) as ``_samples`` gives them for each of several texts that lie one after the other."""
    size = np.diff(off)
    long_enough = np.flatnonzero(size >= length)
    if not len(long_enough):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    if len(data) >= 1 << _POSITION:
        found = [(i, *_samples(data[off[i] : off[i + 1]], length, window, gram)) for i in long_enough.tolist()]
        return np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found]), *(np.concatenate([f[k] for f in found]) for k in (1, 2))
    prefix, m = T.prefix_hash(data), len(data) - gram + 1
    raw = (prefix[gram:] - prefix[:m]) * T.powers(len(prefix), T.BASE_INVERSE)[:m]
    name = T.mix(raw ^ np.uint64(gram * 0xD6E8FEB86659FD93 % (1 << 64)))  # span_hash of each gram
    least = sliding_min((name >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(m, dtype=np.uint64), window - gram + 1)
    windows = size[long_enough] - window + 1
    ends = np.cumsum(windows)
    at = np.arange(ends[-1]) + np.repeat(off[long_enough] - ends + windows, windows)
    place = (least[at] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # no place is in two texts
    lo, hi, place = at[first], at[np.append(first[1:], len(at)) - 1], place[first]
    row = np.searchsorted(off, place, "right") - 1
    some = place + window <= off[row + 1]
    gap = np.diff(place, append=place[-1])
    gap[:-1] *= some[1:] & (row[1:] == row[:-1])
    own = np.clip(np.minimum(hi, off[row + 1] - length) - lo + 1, 0, None)
    shape = place - off[row] << 33 | gap << 22 | (place - lo) << 11 | own
    return row[some], shape[some], T.span_hash(prefix, place[some], place[some] + window)


def _find_anchors(length: int, window: int, gram: int):
    def run(batches):
        T.keep("", {})
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            data, off = T.buffers(b.column("text"))
            held, size = [], 0
            for lo, hi in T.slices(off, TOGETHER):
                row, shape, bucket = samples(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, window, gram)
                held.append([k1[lo + row], k2[lo + row], shape, bucket])
                size += len(shape)
                if size > 50_000:
                    yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], ANCHORS)
                    held, size = [], 0
            if held:
                yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], ANCHORS)

    return run


def _lists(column, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, ``name``, b) of a column of lists of (name, b); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    each = column.flatten()
    return np.append(0, np.cumsum(size)), each.field(name).to_numpy(), each.field("b").to_numpy()


def _steps(x: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance to the sample after the chain, distance to its last) of shapes or later entries."""
    return (x >> 33, x >> 22 & _LOW, np.zeros(len(x), np.int64)) if first else (x >> 33, x >> 16 & 0x1FFFF, x & 0xFFFF)


def _pair(most: int, first: bool):
    """Each suffix with the one after its chain; the two chains together span ``most`` bytes at most."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            off, x, bucket = _lists(b.column("spots"), "x")
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            place, after, last = _steps(x, first)
            order = np.lexsort((place, row))
            row, place, after, last, bucket = row[order], place[order], after[order], last[order], bucket[order]
            key = row.astype(np.int64) << 32 | place
            want = key + after
            to = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            ok = np.flatnonzero((after > 0) & (key[to] == want)) if len(key) else to
            to = to[ok]
            reach, beyond = after[ok] + last[to], np.where(after[to] > 0, after[ok] + after[to], 0)
            near = reach <= most
            ok, to, reach, beyond = ok[near], to[near], reach[near], beyond[near]
            at = place[ok] << 33 | beyond << 16 | reach
            times = np.where(b.column("twice").to_numpy(zero_copy_only=False), 2, 1)[row[ok]]  # a repeated row is not alone in its bucket
            ok, to, at = (np.repeat(x, times) for x in (ok, to, at))
            yield _batch([k1[row[ok]], k2[row[ok]], at, bucket[ok], after[ok], bucket[to]], PAIRS)

    return run


def chains(shape: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], length: int, window: int):
    """(sample, first window, last window, name) of the runs of windows of one text whose chains repeat.

    shape: of the samples left, ascending; levels: (place, bucket) by depth 1, 2, 4, ...
    """
    place, gap, back, own = shape >> 33, shape >> 22 & _LOW, shape >> 11 & _LOW, shape & _LOW
    n = len(place)
    named = []
    for at, b in levels:
        ids = np.full(n, -1, np.int64)
        ids[np.searchsorted(place, at)] = b
        named.append(ids)
    follows = np.zeros(n, bool)
    follows[:-1] = (gap[:-1] > 0) & (place[1:] == place[:-1] + gap[:-1])
    end = np.where(gap > 0, place + gap + window - length, np.iinfo(np.int64).max)  # windows from here on hold the next sample, too
    lo, hi = place - back, place - back + own - 1
    i, m, out = np.flatnonzero(own > 0), 0, []
    while len(i):
        z = i + m
        k = (m + 1).bit_length() - 1
        if k >= len(named):
            break
        a, b = np.maximum(lo[i], place[z] + window - length), np.minimum(hi[i], end[z] - 1)
        second = z + 1 - (1 << k)
        x, y = named[k][i], named[k][second]
        some = (a <= b) & (x >= 0) & (y >= 0)
        name = T.mix(T.mix(x.astype(np.uint64) * np.uint64(64) + np.uint64(k)) ^ (y.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (place[second] - place[i]).astype(np.uint64)))
        out.append((i[some], a[some], b[some], name[some]))
        i = i[follows[z] & (end[z] <= hi[i]) & (x >= 0)]
        m += 1
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _name_runs(length: int, window: int, depth: int):
    """Names of the runs, and of all their bytes."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            lists = [_lists(b.column(f"spots{k}"), "x") for k in range(depth)]
            data, offsets = T.buffers(b.column("text"))
            for first, end in T.slices(offsets, TOGETHER):  # texts one after the other are as one: no chain goes on past a text's end
                text_at = offsets[first : end + 1] - offsets[first]
                levels = []
                for off, x, ids in lists:
                    x, ids = x[off[first] : off[end]], ids[off[first] : off[end]]
                    levels.append((x + (np.repeat(text_at[:-1], np.diff(off[first : end + 1])) << 33), ids))
                order = np.argsort(levels[0][0])
                shape = levels[0][0][order]
                at, a, z, core = chains(shape, [(shape >> 33, levels[0][1][order]), *((x >> 33, ids) for x, ids in levels[1:])], length, window)
                if not len(a):
                    continue
                reach = T.span_hash(T.prefix_hash(data[offsets[first] : offsets[end]]), a, z + length) ^ T.mix(((shape[at] >> 33) - a).astype(np.uint64) + np.uint64(0x51ED27))
                row = np.searchsorted(text_at, a, "right") - 1
                yield _batch([k1[first + row], k2[first + row], a - text_at[row] << 32 | (z - a), core, reach], RUNS)

    return run


def _name_windows(length: int):
    def run(batches):
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            off, spans, cores = _lists(b.column("asked"), "x")
            for i, data in _texts(b):
                span, kept = np.unique(spans[off[i] : off[i + 1]], return_index=True)
                times = (span & 0xFFFFFFFF) + 1
                s = np.repeat((span >> 32) - np.cumsum(times) + times, times) + np.arange(times.sum())
                core = np.repeat(cores[off[i] : off[i + 1]][kept], times)
                yield _batch([np.full(len(s), k1[i]), np.full(len(s), k2[i]), s, core, T.span_hash(T.prefix_hash(data), s, s + length)], WINDOWS)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, kept binary"


def _remove(length: int):
    def run(batches):
        for b in batches:
            marks = b.column("marks").to_pylist()
            data, off = T.buffers(b.column("text"))
            out: list[list] = [[] for _ in range(6)]
            for i, m in enumerate(marks):
                raw = data[off[i] : off[i + 1]]
                spans: list[list[int]] = []
                for x in sorted((x["lo"], x["hi"] + length) for x in m or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append([*x])
                keep, at = [], 0
                for a, z in spans:
                    keep.append(raw[at:a].tobytes())
                    at = z
                keep = b"".join([*keep, raw[at:].tobytes()])
                for column, x in zip(out, (len(raw), len(raw) - len(keep), len(spans), hashlib.sha256(keep).hexdigest(), [y for s in spans for y in s], keep), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], [f.split()[0] for f in RESULT.split(", ")])

    return run


def _ids(rows: DataFrame, columns: list[str], name: str, ws: Workspace) -> DataFrame:
    """An identifier b for each combination of columns that stands twice or more, in sorted order."""
    several = rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").select(*columns)
    return ws.save(several.repartitionByRange(partitions(ws.spark), *columns).sortWithinPartitions(*columns).withColumn("b", F.monotonically_increasing_id()), name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept bytes per document."""
    if not (gram <= window and 2 * window - gram <= length and length - window < 1 << 15 and window - gram < _LOW):
        raise ValueError("2 * window - gram must be at most length, and window - gram below 2047")
    ws = Workspace(docs.sparkSession, "substrings")
    texts = _keyed(docs)
    key = ["k1", "k2"]

    def gathered(rows: DataFrame, x: str, name: str) -> DataFrame:
        # Lists are written before they meet the texts: by then the shuffles behind them are gone.
        each = rows.groupBy(*key).agg(F.collect_set(F.struct(F.col(x).alias("x"), "b")).alias("spots"), F.count("*").alias("n"))
        return ws.save(each.select(*key, "spots", (F.col("n") > F.size("spots")).alias("twice")), name)

    found = ws.save(texts.select(*key, "text").mapInArrow(_find_anchors(length, window, gram), ANCHORS), "anchors")
    levels = [gathered(found.join(apart(_ids(found, ["bucket"], "ids-0", ws)), "bucket"), "shape", "level-0")]
    ws.drop("anchors", "ids-0")
    while True:
        k = len(levels)
        pairs = ws.save(levels[-1].mapInArrow(_pair(length - window, k == 1), PAIRS), f"pairs-{k}")
        level = gathered(pairs.join(apart(_ids(pairs, ["p", "gap", "q"], f"ids-{k}", ws)), ["p", "gap", "q"]), "at", f"level-{k}")
        ws.drop(f"pairs-{k}", f"ids-{k}")
        if level.isEmpty():
            break
        levels.append(level)
    long_enough = texts.select(*key, "text").filter(F.octet_length("text") >= length)  # no other text has a sample
    parts = []
    for part in range(PARTS):
        mine = F.pmod("k1", F.lit(PARTS)) == part
        joined = long_enough.filter(mine)
        for k, level in enumerate(levels):
            joined = joined.join(level.filter(mine).select(*key, F.col("spots").alias(f"spots{k}")).hint("merge"), key, "left" if k else "inner")
        parts.append(ws.save(joined.mapInArrow(_name_runs(length, window, len(levels)), RUNS), f"runs-{part}"))
    runs = reduce(DataFrame.unionByName, parts)
    ws.drop(*[f"level-{k}" for k in range(len(levels) + 1)])

    reaches = runs.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(F.struct(*key, "span")).alias("chosen"))
    cores = reaches.groupBy("core").agg(F.sum("n").alias("total"), F.max(F.col("n") == 1).alias("single"), F.count("*").alias("kinds")).filter("total > 1")
    judged = ws.save(reaches.join(cores, "core"), "judged")
    # One member of each reach of a mixed bucket stands for all that are equal to it.
    asked = ws.save(judged.filter("single and kinds > 1").select("core", "chosen.*").groupBy(*key).agg(F.collect_list(F.struct(F.col("span").alias("x"), F.col("core").alias("b"))).alias("asked")), "asked")
    lo = F.shiftright("span", 32)
    whole = ws.save(runs.join(judged.filter("n > 1").select("core", "reach"), ["core", "reach"]).select(*key, lo.alias("lo"), (lo + F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))).alias("hi")), "whole")
    ws.drop("judged", *[f"runs-{part}" for part in range(PARTS)])
    windows = ws.save(long_enough.join(asked.hint("merge"), key).mapInArrow(_name_windows(length), WINDOWS), "windows")
    ws.drop("asked")
    equal = windows.groupBy("core", "name").agg(F.count("*").alias("n")).filter("n > 1").select("core", "name")
    single = ws.save(windows.join(apart(equal), ["core", "name"]).select(*key, F.col("start").alias("lo"), F.col("start").alias("hi")), "single")
    ws.drop("windows")
    marks = ws.save(whole.unionByName(single).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("marks")), "marks")
    ws.drop("whole", "single")
    return texts.join(marks.hint("merge"), key, "left").select("doc_id", "text", "marks").mapInArrow(_remove(length), RESULT)
