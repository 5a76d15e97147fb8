"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of line ids. Its repeated lines are places (``t``: document by
``doc_id``, then line); a line that stands once ends every sequence that reaches it.

1. Prefix doubling. A place's path has an identifier for its first 1, 2, 4, ... lines. A
   round sorts the pairs (bucket here, path 2**k lines on) by range and gives each pair an
   identifier in that order. Places alone in their bucket, and those whose sequence ended,
   are done; rounds end when all are. Paths then sort as the suffixes do.
2. The suffix array is the range sort by (path, t). The longest common prefix of two
   neighbours follows from their paths: as many lines as the last common identifier names,
   and the same again from there on.
3. Intervals. All places between which no common prefix is under m lines are an interval
   of depth m: copies of one run of m lines. For each place the deepest interval that also
   holds an earlier place is found by a stack over each range of the array; stacks left
   over at the end of a range, which hold one place per depth at most, meet on the driver
   and start the next range. That run is a later copy, and its lines go.

Runs of at least ``min_chars`` code points count; by default that is every run with a
line that is not blank.

Null and empty texts have no lines and stay as they are. Rows with equal id and text are
one place in the order, so they keep the same lines. Null ids come last. Blank lines (of
white space) are ordinary lines of length 0. Columns with any name pass through, but for
the results, which replace columns of their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import Workspace, apart, literal_rows, partitions

#: Code points of a run from which later copies are deleted.
MIN_CHARS = 1
#: Bits of a place for the line; the rest is the document's number.
LINE_BITS = 28

LINES = "doc_id long, key long, line int, h1 long, h2 long"


def _lines(batches):
    keys2 = np.roll(T.BYTE_KEYS, 97)
    T.keep("", {})
    for b in batches:
        names, key = b.column("doc_id"), b.column("key").to_numpy()
        data, off = T.buffers(b.column("text"))
        for lo, hi in T.slices(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            breaks = np.flatnonzero(part == 10)
            some = np.flatnonzero(np.diff(o) > 0)
            starts = np.sort(np.concatenate([o[:-1][some], breaks + 1]))
            ends = np.sort(np.concatenate([o[1:][some], breaks]))
            inside = np.searchsorted(breaks, o)
            row = np.repeat(some, np.diff(inside)[some] + 1)  # a text has a line more than breaks
            head = np.searchsorted(row, row)
            line = np.arange(len(row)) - head
            h1, h2 = T.span_hash(T.prefix_hash(part), starts, ends), T.span_hash(T.prefix_hash(part, keys2), starts, ends)
            yield pa.RecordBatch.from_arrays(
                [names.slice(lo, hi - lo).take(pa.array(row)), pa.array(key[lo:hi][row]), pa.array(line.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                [x.split()[0] for x in LINES.split(", ")],
            )


def _numbered(rows: DataFrame, by: list, name: str, ws: Workspace) -> DataFrame:
    """rows in order, with their range (part) and place in it (idx)."""
    made = rows.repartitionByRange(partitions(ws.spark), *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return ws.save(made.select(*rows.columns, F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("idx")), name)


def _documents(lines: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, key, d): documents numbered from 0 by id, null ids last."""
    each = _numbered(lines.filter("line = 0").select("doc_id", "key").distinct(), [F.col("doc_id").asc_nulls_last(), F.col("key")], "documents", ws)
    before, run = [], 0
    for r in sorted(each.groupBy("part").count().collect()):  # one row per range
        before.append({"part": r["part"], "before": run})
        run += r["count"]
    return each.join(F.broadcast(literal_rows(ws.spark, before, "part: int, before: bigint")), "part").select("doc_id", "key", (F.col("before") + F.col("idx")).alias("d"))


def suffix_paths(lines: DataFrame, ws: Workspace) -> DataFrame:
    """(t, path) of all places with a repeated line; paths sort as the suffixes from there do."""
    several = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    names = _numbered(several, ["h1", "h2"], "ids-0", ws)
    ident = (F.shiftleft(F.col("part").cast("long"), 33) + F.col("idx")).alias("id")
    first = lines.join(names.select("h1", "h2", ident), ["h1", "h2"]).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "line", "id")
    docs = _documents(lines, ws)
    t = (F.shiftleft("d", LINE_BITS) + F.col("line")).alias("t")
    placed = first.join(docs, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("key"))).select(t, F.array("id").alias("path"), F.lit(True).alias("open"))
    now, done, k = ws.save(placed.distinct(), "paths-0"), None, 0  # rows that repeat id and text are one
    while True:
        every = now if done is None else now.unionByName(done)
        beyond = every.select((F.col("t") - (1 << k)).alias("t"), F.col("path").alias("next"), F.col("open").alias("more"))
        pairs = now.filter("open").join(beyond, "t", "left").select("t", "path", F.element_at("path", -1).alias("id"), F.coalesce("next", F.array().cast("array<bigint>")).alias("next"), F.coalesce("more", F.lit(False)).alias("more"))
        pairs = ws.save(pairs, f"pairs-{k}")
        if pairs.isEmpty():
            return every.select("t", "path")
        ids = _numbered(pairs.groupBy("id", "next").agg(F.count("*").alias("n")), ["id", "next"], f"ids-{k + 1}", ws)
        ids = ids.select("id", "next", "n", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("idx")).alias("new"))
        again = pairs.join(apart(ids), ["id", "next"]).select("t", F.concat("path", F.array("new")).alias("path"), (F.col("more") & (F.col("n") > 1)).alias("open"))
        ended = now.filter("not open")
        done = ended if done is None else done.unionByName(ended)
        now, k = ws.save(again, f"paths-{k + 1}"), k + 1
        ws.drop(f"pairs-{k - 1}", f"ids-{k}")


def _common(x, y):
    """Lines that two paths are known to share, and whether there may be more."""
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), lambda e: e))
    # Equal paths ended together: only what their last round compared is known to be equal.
    depth = F.when(x == y, same - 1).otherwise(same)
    return F.when(depth > 0, F.call_function("shiftleft", F.lit(1), depth - 1)).otherwise(F.lit(0)), (same > 1)


def neighbours(paths: DataFrame, ws: Workspace) -> DataFrame:
    """(part, idx, t, lcp): the suffix array in ranges, with the lines shared with the place before."""
    array = _numbered(paths, ["path", "t"], "array", ws)
    last, tails = None, []
    for r in sorted(array.groupBy("part").agg(F.max(F.struct("idx", "t", "path")).alias("x")).collect()):  # one row per range
        tails.append({"part": r["part"], "tail": last and last[0], "tail_path": last and last[1]})
        last = (r["x"]["t"], list(r["x"]["path"]))
    heads = literal_rows(ws.spark, tails, "part: int, tail: bigint, tail_path: array<bigint>")
    order = Window.partitionBy("part").orderBy("idx")
    both = array.join(F.broadcast(heads), "part").withColumn("before", F.lag(F.struct("t", "path")).over(order))
    both = both.select("part", "idx", "t", "path", F.coalesce("before.t", "tail").alias("u"), F.coalesce("before.path", "tail_path").alias("other"))
    got, more = _common(F.col("path"), F.col("other"))
    step = both.select("part", "idx", "t", "u", F.coalesce(got, F.lit(0)).cast("long").alias("lcp"), F.coalesce(more, F.lit(False)).alias("more"))
    now, k, done = ws.save(step, "lcp-0"), 0, None
    while not (rest := now.filter("more")).isEmpty():
        ended = now.filter("not more")
        done = ended if done is None else done.unionByName(ended)
        x, y = paths.select(F.col("t").alias("a"), F.col("path").alias("x")), paths.select(F.col("t").alias("b"), F.col("path").alias("y"))
        at = rest.withColumn("a", F.col("t") + F.col("lcp")).withColumn("b", F.col("u") + F.col("lcp")).join(x, "a", "left").join(y, "b", "left")
        got, more = _common(F.col("x"), F.col("y"))
        step = at.select("part", "idx", "t", "u", (F.col("lcp") + F.coalesce(got, F.lit(0))).alias("lcp"), F.coalesce(more, F.lit(False)).alias("more"))
        now, k = ws.save(step, f"lcp-{k + 1}"), k + 1
    return (now if done is None else done.unionByName(now)).select("part", "idx", "t", "lcp")


def sweep(t: list[int], lcp: list[int], stack: list[tuple[int, int]]) -> list[int]:
    """Per place, the most lines shared with a smaller place before it in the array.

    stack: (place, lines shared from there up to here), both ascending; it is changed to
    the one after the last place.
    """
    out = []
    for place, shared in zip(t, lcp, strict=True):
        least = None
        while stack and stack[-1][1] >= shared:
            least = stack.pop()[0]
        if least is not None and shared > 0:
            stack.append((least, shared))
        while stack and stack[-1][0] > place:
            stack.pop()
        out.append(stack[-1][1] if stack else 0)
        stack.append((place, 1 << 62))
    return out


def passed(stack: list[tuple[int, int]], shared: int, after: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A stack carried over a range that shares ``shared`` lines throughout and leaves ``after``."""
    kept = [x for x in stack if x[1] < shared]
    if len(kept) < len(stack) and shared > 0:
        kept.append((stack[len(kept)][0], shared))
    return [x for x in kept if x[0] < after[0][0]] + after


def _ranges(batches) -> Iterator[tuple[int, list[int], list[int]]]:
    held: list[list] = [[], [], []]
    for b in batches:
        part = b.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held[0] and held[0][0] != part[a]:
                yield held[0][0], held[1], held[2]
                held = [[], [], []]
            held[0] = [int(part[a])]
            held[1] = held[1] + b.column("t")[a:z].to_pylist()
            held[2] = held[2] + b.column("lcp")[a:z].to_pylist()
    if held[0]:
        yield held[0][0], held[1], held[2]


_STACK = "array<struct<t:bigint,d:bigint>>"
_STACK_TYPE = pa.list_(pa.struct([("t", pa.int64()), ("d", pa.int64())]))


def _summaries(batches):
    for part, t, lcp in _ranges(batches):
        left, right = [], []
        sweep(t, [0, *lcp[1:]], left)
        sweep(t[::-1], [0, *lcp[:0:-1]], right)
        stacks = [pa.array([[{"t": x, "d": d} for x, d in s]], _STACK_TYPE) for s in (left, right)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lcp[0]], pa.int64()), pa.array([min(lcp[1:], default=1 << 62)], pa.int64()), *stacks], ["part", "head", "least", "ahead", "behind"])


def _earlier(states: dict[int, tuple[list, list, int]]):
    def run(batches):
        for part, t, lcp in _ranges(batches):
            left, right, after = states[part]
            a = sweep(t, lcp, list(left))
            b = sweep(t[::-1], [after, *lcp[:0:-1]], list(right))[::-1]
            best = np.maximum(a, b)
            some = np.flatnonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(t, np.int64)[some]), pa.array(best[some].astype(np.int64))], ["t", "m"])

    return run


def earlier_runs(array: DataFrame) -> DataFrame:
    """(t, m): the longest run of m lines from t that also starts at an earlier place, where there is one."""
    rows = array.repartition("part").sortWithinPartitions("part", "idx")
    found = sorted(rows.mapInArrow(_summaries, f"part int, head long, least long, ahead {_STACK}, behind {_STACK}").collect())  # a row per range
    plain = lambda stack: [(x["t"], x["d"]) for x in stack]
    ahead, behind, state = {}, {}, []
    for r in found:
        ahead[r["part"]] = state
        state = passed(state, min(r["head"], r["least"]), plain(r["ahead"]))
    state, after, head = [], {}, 0
    for r in reversed(found):
        behind[r["part"]], after[r["part"]] = state, head
        state = passed(state, min(head, r["least"]), plain(r["behind"]))
        head = r["head"]
    return rows.mapInArrow(_earlier({p: (ahead[p], behind[p], after[p]) for p in ahead}), "t long, m long")


def copies(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, key, lo, hi): runs of lines [lo, hi) that stand earlier too.

    docs: doc_id, key (tells rows apart), text.
    """
    lines = ws.save(docs.select("doc_id", "key", "text").mapInArrow(_lines, LINES), "lines")
    paths = ws.save(suffix_paths(lines, ws), "paths")
    array = ws.save(neighbours(paths, ws), "neighbours")
    runs = earlier_runs(array).select(F.shiftright("t", LINE_BITS).alias("d"), F.col("t").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("lo"), "m")
    return runs.join(_documents(lines, ws), "d").select("doc_id", "key", "lo", (F.col("lo") + F.col("m")).cast("int").alias("hi"))


RESULT = "kept string, n_lines long, n_removed long"


def _delete(least: int, own: int):
    """own: number of columns that pass through, before text and cuts."""

    def run(batches):
        for b in batches:
            texts, cuts = b.column(own).to_pylist(), b.column(own + 1).to_pylist()
            kept, total, gone = [], [], []
            for text, cut in zip(texts, cuts, strict=True):
                if not text or not cut:
                    kept.append(text)
                    total.append(text.count("\n") + 1 if text else 0)
                    gone.append(0)
                    continue
                lines = text.split("\n")
                upto = np.append(0, np.cumsum([len(x) if x.strip(" \t\n\v\f\r") else 0 for x in lines]))
                drop = np.zeros(len(lines) + 1, np.int64)
                for c in cut:
                    if upto[c["hi"]] - upto[c["lo"]] >= least:
                        drop[c["lo"]] += 1
                        drop[c["hi"]] -= 1
                drop = np.cumsum(drop[:-1]) > 0
                kept.append(text if not drop.any() else "\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d))
                total.append(len(lines))
                gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(own)], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names[:own], "kept", "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without text, with kept (the text left; null stays), n_lines and n_removed."""
    ws = Workspace(docs.sparkSession, "lines")
    base = docs.drop("kept", "n_lines", "n_removed")
    names = [c for c in base.columns if c != "text"]
    keyed = base.select(F.struct(*names).alias("_own"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"), F.col("text").alias("_text"))
    ids = keyed.select(F.col("_id").alias("doc_id"), F.col("_key").alias("key"), F.col("_text").alias("text"))
    cuts = ws.save(copies(ids, ws).groupBy("key", "doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "cuts")
    ws.drop("lines", "paths", "neighbours", "array", *[f"{x}-{k}" for x in ("paths", "lcp") for k in range(LINE_BITS + 2)])
    # One join strategy at every size: with few cuts a broadcast would do, with many it would not.
    joined = keyed.join(cuts.hint("merge"), (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left").select("_own.*", F.col("_text"), F.col("cuts").alias("_cuts"))
    schema = base.select(*names).schema
    for f in RESULT.split(", "):
        schema = schema.add(*f.split())
    return joined.mapInArrow(_delete(min_chars, len(names)), schema)


def digest(column="kept"):
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
