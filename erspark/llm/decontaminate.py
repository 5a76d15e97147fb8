"""Benchmark decontamination with a distributed positional inverted index.

``index`` writes the postings of every word of the corpus, one row (segment) per few MB of
text: sorted term keys and, per term, its ascending word ordinals in the segment as
delta varints. A document lies in one segment, so a segment answers for its documents
alone and a frequent term or passage is dealt over all segments.

``search`` sends the benchmark's windows to every segment. A window starts from the
postings of its rarest term over the whole corpus, shifted by the term's place in the
window, and meets the other shifted lists from rare to frequent until none is left.
``Segment.near`` gives proximity matches in the same way.

Words are compared by a 64-bit hash of their bytes. Null texts have no words; items
without words have no windows; item ids repeat freely (their texts add up, a null id is
the text "null"); repeated documents are answered one by one; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import Workspace, ship

WINDOW = 10
#: Text bytes of a segment, unless one document is longer.
SEGMENT_BYTES = 4 << 20
#: Benchmark bytes that are sent to the segments at once; larger ones take several searches.
BENCHMARK_BYTES = 1 << 20

#: Bytes of words, after lower-casing A-Z: digits, a-z and all of other scripts.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

INDEX = "segment long, doc_ids array<bigint>, n_words array<bigint>, terms binary, ends binary, postings binary"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>"
HITS = "segment long, doc long, doc_id long, n_words long, spans array<int>, items array<string>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all words in order."""
    rows, keys = [], []
    for a, b in T.slices(offsets):
        part, off = T.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        row, start, end = T.runs(WORD_BYTE[part], off)
        rows.append(row + a)
        keys.append(T.span_hash(T.prefix_hash(part), start, end))
    z = np.empty(0, np.int64)
    return np.concatenate([z, *rows]), np.concatenate([z.astype(np.uint64), *keys])


def to_varint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each) of non-negative numbers below 2**35, low bits first."""
    size = 1 + sum((x >> s > 0).astype(np.int64) for s in (7, 14, 21, 28))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = end - size
    for k in range(5):
        has = size > k
        out[at[has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def from_varint(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _index(batches):
    from pyspark import TaskContext

    T.keep("", {})
    segment = TaskContext.get().partitionId() << 32
    for b in batches:
        names = b.column(0)
        data, off = T.buffers(b.column(1))
        for lo, hi in T.slices(off, SEGMENT_BYTES):
            row, key = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            counts = np.bincount(row, minlength=hi - lo)
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
            gap = np.diff(order, prepend=0)
            gap[head] = order[head]
            raw, size = to_varint(gap)
            first = np.flatnonzero(head)
            ends = np.cumsum(size)[np.append(first[1:] - 1, len(key) - 1)] if len(key) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([names.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([key[first].tobytes()], pa.binary()), pa.array([ends.astype("<u4").tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary())],
                ["segment", "doc_ids", "n_words", "terms", "ends", "postings"],
            )
            segment += 1


class Segment:
    """Postings of a row of the index; ordinals count the words of all its documents."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.raw = np.frombuffer(row["postings"], np.uint8)
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.first = np.append(0, np.cumsum(self.n_words))
        self.opened: dict[int, np.ndarray] = {}

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the segment's dictionary, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, place: int) -> np.ndarray:
        if place not in self.opened:
            self.opened[place] = np.cumsum(from_varint(self.raw[self.ends[place - 1] if place else 0 : self.ends[place]]))
        return self.opened[place]

    def doc(self, ordinals: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, ordinals, "right") - 1

    def phrase(self, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        """First ordinals where the words stand next to each other in one document.

        order: places in the phrase, rarest first.
        """
        found = None
        for k in order:
            here = self.postings(int(places[k])) - k
            if found is None:
                found = here[here >= 0]
            else:
                at = np.searchsorted(here, found)
                at[at == len(here)] = 0
                found = found[here[at] == found]
            if not len(found):
                return found
        return found[self.doc(found) == self.doc(np.minimum(found + len(places) - 1, self.first[-1] - 1))] if len(found) else found

    def near(self, places: np.ndarray, order: np.ndarray, within: int) -> np.ndarray:
        """Ordinals of the rarest word with every other one at most ``within`` words away in the same document."""
        found = self.postings(int(places[order[0]]))
        doc = self.doc(found)
        for k in order[1:]:
            here = self.postings(int(places[k]))
            lo = np.maximum(found - within, self.first[doc])
            hi = np.minimum(found + within, self.first[doc + 1] - 1)
            keep = np.searchsorted(here, hi, "right") > np.searchsorted(here, lo)
            found, doc = found[keep], doc[keep]
        return found


class Query:
    """Windows of a part of the benchmark: distinct rows of term numbers, and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, off = T.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        row, key = words(data, off)
        self.terms, number = np.unique(key, return_inverse=True)
        of: dict[tuple, set] = defaultdict(set)
        at = np.searchsorted(row, np.arange(len(items) + 1))
        for i, (name, _) in enumerate(items):
            w = number[at[i] : at[i + 1]].tolist()
            for k in range(max(1, len(w) - window + 1) if w else 0):
                of[tuple(w[k : k + window])].add(name)
        self.windows = [np.array(w, np.int64) for w in of]
        self.items = [sorted(x) for x in of.values()]

    def rank(self, frequency: dict[int, int]) -> None:
        """Orders the words of each window from rare to frequent."""
        df = np.array([frequency.get(int(np.int64(t)), 0) for t in self.terms.view(np.int64)], np.int64)
        self.order = [np.argsort(df[w], kind="stable") for w in self.windows]
        self.rarest = np.array([w[o[0]] for w, o in zip(self.windows, self.order, strict=True)], np.int64)


def _frequency(terms: np.ndarray):
    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for row in b.select(["terms", "ends", "postings"]).to_pylist():
                at = np.searchsorted(t := np.frombuffer(row["terms"], np.uint64), terms)
                at[at == len(t)] = 0
                has = t[at] == terms if len(t) else np.zeros(len(terms), bool)
                # bytes of postings, which tell rare terms from frequent ones as well as their number
                ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
                total[has] += np.diff(ends, prepend=0)[at[has]]
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(total)], ["term", "n"])

    return run


def _search(query: Query):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Segment(row)
                places = s.places(query.terms)
                n = len(s.doc_ids)
                hit = np.zeros(s.first[-1] + 1, np.int64)
                items: dict[int, set] = defaultdict(set)
                for i in np.flatnonzero(places[query.rarest] >= 0).tolist() if len(query.windows) else []:
                    w = places[query.windows[i]]
                    if (w < 0).any():
                        continue
                    found = s.phrase(w, query.order[i])
                    if len(found):
                        np.add.at(hit, found, 1)
                        np.add.at(hit, found + len(w), -1)
                        for d in set(s.doc(found).tolist()):
                            items[d].update(query.items[i])
                inside = np.append(False, np.cumsum(hit[:-1]) > 0)
                edges = np.flatnonzero(np.diff(np.append(inside, False).astype(np.int8)))
                spans: dict[int, list] = defaultdict(list)
                for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    for d in range(int(s.doc(np.array([a]))[0]), int(s.doc(np.array([z - 1]))[0]) + 1):
                        spans[d] += [max(a, int(s.first[d])) - int(s.first[d]), min(z, int(s.first[d + 1])) - int(s.first[d])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(s.doc_ids, pa.int64()), pa.array(s.n_words), pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                    [x.split()[0] for x in HITS.split(", ")],
                )

    return run


def index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index of (doc_id, text); write them before searching."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_index, INDEX)


def _parts(benchmark: DataFrame, limit: int):
    """(number of parts, iterator): the benchmark in lists of (item, text) of about ``limit`` bytes, one at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // limit))

    def parts():
        for i in range(n):
            some = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
            yield [(r["item"], r["text"]) for r in some.toLocalIterator()]

    return n, parts()


def merge_spans(spans: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _results(batches):
    for b in batches:
        rows = b.to_pydict()
        hits = [sum(z - a for a, z in merge_spans(s)) for s in rows["spans"]]
        items = [sorted(set(x)) for x in rows["items"]]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), b.column("spans"), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )


def search(segments: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items per document.

    spans: word ranges [a, b) of the hits, flattened.
    """
    n, parts = _parts(benchmark, limit)
    found = None
    for items in parts:
        query = Query(items, window)
        counts = segments.select("terms", "ends", "postings").mapInArrow(_frequency(query.terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")) if len(query.terms) else None
        query.rank({r["term"]: r["n"] for r in counts.collect()} if counts is not None else {})  # the benchmark's words only
        run = _search(query)
        if n == 1:  # one function, so that a task needs one worker
            return segments.mapInArrow(lambda batches, run=run: _results(run(batches)), RESULT)
        hits = segments.mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.mapInArrow(_results, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``search`` over an index that is written to the shared folder first."""
    ws = Workspace(docs.sparkSession, "index")
    return search(ws.save(index(docs), "segments"), benchmark, window)
