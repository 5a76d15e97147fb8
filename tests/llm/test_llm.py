"""Training-data operators against brute force, round trips and edge cases."""

import functools
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from erspark.llm import chat, decontaminate, graph, huffman, language, licenses, lines, packing, simhash, substrings, syncmers
from erspark.llm import queries as llm_queries
from erspark.llm import text as T
from erspark.llm.store import Workspace
from erspark.llm.tokens import BatchEncoder, vocabulary_path

SCHEMA = "doc_id long, text string"
#: Nulls, empty and long texts, ties, repeated rows, a clashing extra column.
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a b c"), (5, "x " * 5000), (6, "x " * 5000), (7, "\n\n"), (8, "é ü 中文 कि"), (9, "!!! ???"), (10, "one two three four five six seven"), (11, "a<|endoftext|>b <|endoftext|>"), (12, "<|endoftext|>")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "kept", 7) for r in EDGES], SCHEMA + ", kept string, n_lines int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(b: bytes) -> bytes:
    return b.translate(T.LOWER_BYTES)


# Tokens, Huffman, packing


@functools.cache
def stock():
    return Tokenizer.from_file(vocabulary_path())


def test_batch_encoder_equals_library():
    e = BatchEncoder(vocabulary_path())
    rng = random.Random(1)
    parts = ["'s", "'ll", "'re", "'", "''", " ", "  ", "\n", "\n\n", "\t", "a", "bc", "É", "1", "23", "!", "..", "中文", " ", "", "'t", " 's", "x'd", "\x85", " ", "<|endoftext|>", "'S", "'v", "'ve", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    data, off = T.buffers(pa.array(texts))
    ids, at = e.encode(data, off)
    for i, t in enumerate(texts):
        assert stock().encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), t


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=200), st.integers(8, 12))
def test_code_lengths(counts, limit):
    got = huffman.code_lengths(np.array(counts), limit)
    used = np.array(counts) > 0
    assert (got[~used] == 0).all() and (got[used] <= limit).all()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in got[used]) == 1.0
        # An unlimited code is never longer in all than a limited one, and equal if it fits.
        import heapq

        heap = [(c, 0) for c in np.array(counts)[used].tolist()]
        heapq.heapify(heap)
        total = deepest = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a[0] + b[0]
            deepest = max(a[1], b[1]) + 1
            heapq.heappush(heap, (a[0] + b[0], deepest))
        cost = int((np.array(counts) * got).sum())
        assert cost >= total and (deepest > limit or cost == total)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.4, 50_000), 4000).astype(np.int32)
    lengths = huffman.code_lengths(np.bincount(ids))
    codes = huffman.canonical_codes(lengths)
    blocks = [(*huffman.pack(ids[a : a + 999], codes, lengths), len(ids[a : a + 999])) for a in range(0, len(ids), 999)]
    assert (huffman.Decoder(lengths).decode(blocks) == ids).all()
    assert (huffman.Decoder(lengths).decode(blocks[5:6]) == ids[5 * 999 : 6 * 999]).all()


def test_crc_join():
    a, b = b"some bytes", b"and more of them"
    assert huffman.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def tokens_of(text, end):
    return np.array([*stock().encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("block", [300, 1 << 16])
def test_token_output(spark, data, edges, empty, monkeypatch, block):
    monkeypatch.setattr(huffman, "BLOCK", block)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted(map(tuple, huffman.token_output(docs, vocabulary_path()).collect()))
    start, want = 0, []
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = tokens_of(t, 0)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    rows = huffman.token_output(edges, vocabulary_path()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x := tokens_of(t, 0)), zlib.crc32(x.tobytes())) for i, t in EDGES)
    assert sorted(r.start for r in rows) == np.append(0, np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1]).tolist()
    assert huffman.token_output(empty, vocabulary_path()).count() == 0


def test_read_ids(spark, edges):
    ws = Workspace(spark, "test")
    huffman.write(edges, ws.path("f"), vocabulary_path(), 0)
    got = Counter((r.doc_id, tuple(r.ids)) for r in huffman.read(spark, ws.path("f")).collect())
    assert got == Counter((i, tuple(tokens_of(t, 0).tolist())) for i, t in EDGES)


def best_fit(histogram, capacity):
    """Sequences of best fit by decreasing length."""
    room = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [(r, i) for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits)[1]] -= size
            else:
                room.append(capacity - size)
    return len(room)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_configurations(histogram):
    plan = packing.configurations(histogram, 60)
    placed: Counter = Counter()
    for config, n in plan:
        assert n > 0 and sum(s * k for s, k in config.items()) <= 60
        for s, k in config.items():
            placed[s] += k * n
    assert dict(placed) == histogram
    assert sum(n for _, n in plan) <= 1.02 * best_fit(histogram, 60) + 1


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 59), st.integers(1, 40), min_size=1, max_size=25))
def test_program_covers_within_its_gap(histogram):
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[s] for s in sizes.tolist()])
    found, bound = packing.solve(sizes, need, 60)
    covered = np.zeros(len(sizes))
    for at, times, amount in found:
        assert amount > 0 and (sizes[at] * times).sum() <= 60
        covered[at] += amount * times
    assert (covered >= need - 1e-6).all() and len(found) <= len(sizes)
    assert bound - 1e-6 <= sum(x for *_, x in found)
    assert bound <= best_fit(histogram, 60) + 1e-6


def test_program_on_documents(spark, data):
    cut = packing.pieces(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), vocabulary_path(), 2)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    part = {s: n for s, n in histogram.items() if s < 1024}
    plan = packing.configurations(part)
    first = sum(int(x + 1e-9) for *_, x in packing.solve(np.array(sorted(part)), np.array([part[s] for s in sorted(part)]), 1024)[0])
    assert sum(n for _, n in plan) <= best_fit(part, 1024) and first >= 0.9 * sum(n for _, n in plan)


def test_knapsack_is_best():
    rng = random.Random(2)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 12), 4)))
        value, most = np.array([rng.random() for _ in sizes]), np.array([rng.randint(1, 5) for _ in sizes])
        times, got = packing.knapsack(sizes, value, most, 20)
        assert (times * sizes).sum() <= 20 and (times <= most).all()
        best = [0.0] * 21
        for s, v, m in zip(sizes.tolist(), value.tolist(), most.tolist(), strict=True):
            for _ in range(m):
                for c in range(20, s - 1, -1):
                    best[c] = max(best[c], best[c - s] + v)
        assert (times * value).sum() == pytest.approx(best[20]) == pytest.approx(got)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, data, edges, empty, capacity):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(docs, vocabulary_path(), 2, capacity).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in ((r.doc_id, r.text) for r in docs.collect()):
        ids, at = tokens_of(t, 2), 0
        assert [r.piece for r in sorted(by_doc[i], key=lambda r: r.piece)] == list(range(-(-len(ids) // capacity)))
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert r.start == at and (r.piece == 0 or r.length == capacity)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for places in by_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.pack_documents(edges, vocabulary_path(), 2, capacity).agg(F.sum("length")).first()[0] == sum(len(tokens_of(t, 2)) for _, t in EDGES)
    assert packing.pack_documents(empty, vocabulary_path(), 2, capacity).count() == 0


# SimHash


def python_fingerprint(text, shingle=3):
    words = lower((text or "").encode()).split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def python_groups(rows, radius):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)


def test_simhash_contract(spark, data, edges, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for df in (docs, edges.select("doc_id", "text")):
        want = [(r.doc_id, python_fingerprint(r.text)) for r in df.collect()]
        got = simhash.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.fp.hex()) for r in got) == Counter((i, f"{f:016x}") for i, f in want)
        assert Counter((r.doc_id, r.component_id) for r in got) == python_groups(want, 2)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [3, 4096])
def test_bk_links_and_large_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "MAX_SHARD", limit)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))) for i in range(250)]
    made = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in rows], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle, words: made)
    got = simhash.near_duplicates(made.select("doc_id", F.lit("").alias("text"))).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == python_groups(rows, 2)


def test_similarity_mode_recall(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(40):
        text = [word() for _ in range(200)]
        rows.append((2 * g, " ".join(text)))
        for at in (30, 90, 150)[: 1 + g % 3]:
            text[at] = word()
        rows.append((2 * g + 1, " ".join(text)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 4, similarity=0.8).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(40)) >= 38
    assert all(got[d] // 2 == d // 2 for d in got)


def test_similarity_is_exact(spark):
    """Links join texts of a shingle Jaccard of 0.8 or more, and no others; repeats do not count."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], []
    for g, same in enumerate([179, 170, 165, 150] * 40):  # of 200 shingles; 0.81, 0.74, 0.70, 0.60
        a = [word() for _ in range(204)]
        b = a[: same + 4] + [word() for _ in range(200 - same)]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
        want.append(same / (400 - same) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 4, similarity=0.8).collect()}
    linked = [got[2 * g + 1] == 2 * g for g in range(len(want))]
    assert all(w for x, w in zip(linked, want, strict=True) if x)
    assert sum(linked) >= 0.95 * sum(want)
    part = [word() for _ in range(40)]
    extra = [word() for _ in range(3)]
    rows = [(1, " ".join(part * 6 + extra)), (2, " ".join(part * 2 + extra)), (3, None), (4, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 4, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_near_pairs_span_and_rest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 5, 120)]
    for i in range(120):
        fps[i] ^= np.left_shift(np.uint64(1), rng.integers(0, 64, 4).astype(np.uint64)) * rng.integers(0, 2, 4).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, 120))
    close = {(i, j) for i in range(120) for j in range(i) if group[i] == group[j] and simhash.distance(fps[i : i + 1], fps[j : j + 1])[0] <= 3}
    a, b, label = simhash.near(group, fps, 3)
    span = {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert span <= close and {x for p in span for x in p} == {x for p in close for x in p}
    z = np.array(sorted(span))
    assert (simhash.labels(120, z[:, 0], z[:, 1]) == label).all()
    known = rng.integers(0, 4, 120)
    a, b, _ = simhash.near(group, fps, 3, known)
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in close if known[i] != known[j]}


def test_components(spark):
    ws = Workspace(spark, "graph")
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = ws.save(spark.createDataFrame(pairs, "a long, b long"), "e")
    root = {r.node: r.root for r in graph.components(edges, ws).collect()}
    assert {root[i] for i in range(31)} == {0} and {root[i] for i in range(100, 140)} == {100}
    assert all(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert graph.components(edges.filter("a < 0"), ws) is None


# Lines


def python_lines(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        ls = rows[k][1].split("\n") if rows[k][1] else []
        drop = set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if sum(map(len, ls[i:j])) >= least:
                    if tuple(ls[i:j]) in seen:
                        drop.update(range(i, j))
                    seen.add(tuple(ls[i:j]))
        out.append((rows[k][0], len(ls), len(drop), "\n".join(x for n, x in enumerate(ls) if n not in drop)))
    return Counter(out)


@pytest.mark.parametrize("least", [10, 35])
def test_line_dedup(spark, least):
    rng = random.Random(5)
    some = ["a", "bb", "a long line of some text here", "", "xyz", "q" * 30, "né"]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "q" * 30 + "\nbb\nxyz"), (502, "a\n" * 40)]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("x")).withColumn("key", F.lit(1)).withColumn("cuts", F.col("doc_id")), least)
    assert got.columns == ["doc_id", "key", "cuts", "kept", "n_lines", "n_removed"] and got.filter("key <> 1 or not cuts <=> doc_id").count() == 0
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept or "") for r in got.collect()) == python_lines(rows, least)


def test_every_repeated_line_goes(spark):
    rng = random.Random(15)
    some = ["a", "}", "short line", "", "", "a line of thirty characters..."]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept or "") for r in got) == python_lines(rows, 1)
    blank = spark.createDataFrame([(1, "one\n  \ntwo"), (2, "three\n  \nfour"), (3, "two\n  \nfive")], SCHEMA)
    assert {r.doc_id: r.kept for r in lines.dedup_lines(blank).collect()} == {1: "one\n  \ntwo", 2: "three\n  \nfour", 3: "  \nfive"}


def test_suffix_array_and_common_prefixes(spark):
    """The array is sorted, and neighbours' common prefixes and earlier runs are those of plain lists."""
    rng = random.Random(21)
    texts = ["\n".join(rng.choice("abcab") for _ in range(rng.randint(1, 25))) for _ in range(14)] + ["a\n" * 37, "a\n" * 20 + "z", "b\nb", "only one"]
    ws = Workspace(spark, "test")
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, key long, text string")
    found = ws.save(docs.mapInArrow(lines._lines, lines.LINES), "lines")
    paths = ws.save(lines.suffix_paths(found, ws), "paths")
    rows = sorted(tuple(r) for r in lines.neighbours(paths, ws).collect())
    count = Counter(x for t in texts for x in t.split("\n"))
    name = {x: i for i, x in enumerate(sorted(count))}

    def suffix(t):
        ls = texts[t >> lines.LINE_BITS].split("\n")[t & ((1 << lines.LINE_BITS) - 1) :]
        cut = next((i for i, x in enumerate(ls) if count[x] == 1), len(ls))
        return [name[x] for x in ls[:cut]]

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    places = [r[2] for r in rows]
    assert len(places) == len(set(places)) == sum(count[x] > 1 for t in texts for x in t.split("\n"))
    by_path = {r.t: r.path for r in paths.collect()}
    assert [by_path[p] for p in places] == sorted(by_path[p] for p in places)
    assert [r[3] for r in rows[1:]] == [common(suffix(a), suffix(b)) for a, b in zip(places[:-1], places[1:], strict=True)]
    got = {r.t: r.m for r in lines.earlier_runs(spark.createDataFrame(rows, "part int, idx long, t long, lcp long")).collect()}
    assert got == {p: m for p in places if (m := max((common(suffix(p), suffix(q)) for q in places if q < p), default=0))}


def test_line_dedup_of_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept or "") for r in got) == python_lines(rows, 1)


def test_line_edges(spark, edges, empty):
    rows = lines.dedup_lines(edges).collect()
    assert len(rows) == len(EDGES)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] is None and kept[2] == "" and kept[5] == "x " * 5000 and kept[6] == ""
    assert lines.dedup_lines(empty).count() == 0


# Chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<&|x", "<&&|", "<<||>>", "a & b", "", None, "line\nbreak", "50% %0A"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate((r, x) for r in ("user", "assistant", "we\nird%", None) for x in nasty) for t in range(2)]
    rows += [(None, 0, "user", "hi"), (99, 1, "assistant", "b"), (99, 0, "user", "a"), (99, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    for r in chat.read_chats(made).collect():
        mine = sorted(((t, x or "", y or "") for c, t, x, y in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.read_turns] == [(x, y) for _, x, y in mine]
        assert list(r.read_loss) == [y for _, x, y in mine if x == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(mine)
    assert chat.chat_digests(df.filter("conv_id < -5")).count() == 0


@pytest.mark.parametrize(("roles", "ok"), [("user assistant", True), ("system user assistant", True), ("user", False), ("assistant user", False), ("user user assistant", False), ("user assistant tool assistant", True), ("system system user assistant", False)])
def test_chat_order(spark, roles, ok):
    df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(df).first()["valid"] == ok


def test_chat_query(spark, data):
    import harness

    assert harness.difference(llm_queries.op1_chat_format(spark, data), harness.duck(data), llm_queries.OP1_SQL) == ""


# Licences


def test_licenses(spark, edges, empty):
    mit = licenses.TEXTS[0][1]
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit), (2, mit.upper().replace(" ", "   ").replace("sublicense", "sub-licence")), (3, mit + " and more"), (4, None), (5, "Copyright 2020 X"), (6, "Some prose.\nReleased under the MIT Licence!\nMore."), (7, "")]
    got = {r.doc_id: r for r in licenses.scan_with_notices(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].license for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[4].digest is None and got[5].digest is None
    assert (got[6].n_notices, got[6].notices) == (1, "MIT")
    assert licenses.scan(edges).count() == len(EDGES) and licenses.scan_with_notices(empty).count() == 0


def test_license_digests(spark):
    """Texts of the system's folder of licences, upper case and rewrapped, against the fixed digests."""
    folder = Path("/usr/share/common-licenses")
    names = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]
    rows, want = [], []
    for n, license_ in names:
        if (folder / n).exists():
            text = (folder / n).read_text()
            rows += [(len(rows), text), (len(rows) + 1, text.upper().replace("\n\n", "\n \n\t")), (len(rows) + 2, text + " and more")]
            want += [license_, license_, None]
    if not rows:
        pytest.skip("no licence texts on this machine")
    got = {r.doc_id: r.license for r in licenses.scan_with_notices(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert len(dict.fromkeys(d for _, d in licenses.DIGESTS)) == len(licenses.DIGESTS)


# Syncmers


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs and the int 1: the hash of each value seeds the next one's."""
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<i" if x == 1 else "<q", x), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def python_anchors(text):
    """(place, 32-bit hash) of closed syncmers of five words, inner two; all words, or all of the text, where there is none."""
    w = re.findall(r"[^\W_]+", text.lower())
    inner = [spark_hash(a, b) for a, b in zip(w, w[1:])] if len(w) >= 5 else []
    out = []
    for i in range(len(inner) - 3):
        window = inner[i : i + 4]
        if min(window) in (window[0], window[3]):
            out.append((i, spark_hash(inner[i], inner[i + 2], inner[i + 3])))
    out = out or [(i, spark_hash(x)) for i, x in enumerate(w)] or [(0, spark_hash(text, 1))]
    return [(i, h & 0xFFFFFFFF) for i, h in out]


def python_elements(text):
    found = python_anchors(text)
    return [((i - (found[n - 1][0] if n else -1)), h) for n, (i, h) in enumerate(found)]


def test_fingerprints(spark, edges, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(30)] + [(40, "same text"), (41, "same text"), (42, None), (43, ""), (44, "?! ..."), (45, "one two three four five"), (46, " ".join(word() for _ in range(20000)))]
    got = {r.doc_id: r for r in syncmers.edited_likeness(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = (python_elements(x) for x in (t, edited, after))
        assert got[i].fingerprint == "".join(f"{gap:x}{h:08x}" for gap, h in own)
        assert got[i].edited_fingerprint == "".join(f"{gap:x}{h:08x}" for gap, h in changed)
        share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
        assert got[i].near_edited == pytest.approx(share(own, changed)) and got[i].near_next == pytest.approx(share(own, following))
        assert got[i].n_anchors == len(own) and got[i].n_in_place == len({*python_anchors(t)} & {*python_anchors(edited)})
    assert got[40].fingerprint == got[41].fingerprint and got[41].near_next == 1.0
    assert got[42].fingerprint == got[43].fingerprint
    for i in range(1, 30):
        assert got[i].near_edited > 0.1 and got[i].near_next < 0.1
    assert syncmers.edited_likeness(edges).count() == len(EDGES)
    assert syncmers.edited_likeness(empty).count() == 0


def test_anchors_move_with_the_text(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300))
    d = spark.createDataFrame([(1, text), (2, "some words before it " + text)], SCHEMA)
    a = defaultdict(set)
    for r in syncmers.anchors(d).collect():
        a[r.doc_id].add((r.place, r.hash))
    assert {(p + 4, h) for p, h in a[1]} <= a[2]
    assert 0.3 < len(a[1]) / 296 < 0.7  # two of four places


# Language


def test_language(spark, data, empty):
    rng = random.Random(9)
    kinds = {"x": "abcde", "y": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(4)) for _ in range(40)), k) for i, k in enumerate(["x", "y"] * 60)]
    rows += [(900, None, "x"), (901, "12 34 !", "y"), (902, "abcd", None), (903, "中文中文", "x"), (904, "", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = language.fit(df.filter("doc_id % 3 > 0"))
    got = {r.doc_id: r for r in language.predict(df.withColumn("score", F.lit("clash")), model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert got[900].lang_pred == got[901].lang_pred == got[904].lang_pred == "und" and got[900].score == 0 and got[901].rejected
    assert got[902].lang_pred == "x" and got[903].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(empty.withColumn("lang", F.lit(None).cast("string"))) is None
    assert language.predict(empty, None).count() == 0
    far = spark.createDataFrame([(1, "#".join("mnop" for _ in range(200)))], SCHEMA)
    assert language.predict(far, model).first()["rejected"]


def test_language_of_copies_is_learned(spark):
    """Texts that repeat count once in the bound of the sample, so a language that is nearly all copies stays in the model."""
    en = [(f"the number {i} of the words that we read and write here", "en") for i in range(40)]
    fr = [("le chat et la souris mangent du fromage dans la maison", "fr")] * 3000 + [("123", "fr")]
    de = [("der Hund und die Katze schlafen in dem Haus", "de")]
    rows = spark.createDataFrame(en + fr + de, "text string, lang string")
    for sample in (6, 3):
        assert language.fit(rows, sample=sample, k=2).languages == ["de", "en", "fr"]


def test_language_held_out(spark, data):
    got = llm_queries.op7_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


# Decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def python_hits(docs, bench, window):
    wins = []
    for i, t in bench:
        w = words_of(t)
        wins += [("null" if i is None else str(i), w[k : k + window]) for k in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, items = np.zeros(len(w), bool), set()
        for item, q in wins:
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    hit[k : k + len(q)] = True
                    items.add(item)
        out.append((i, len(w), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit.any())))
    return Counter(out)


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 2000)
    rng = random.Random(10)
    vocabulary = ["a", "b", "the", "Of", "é", "x1", "zz", "und"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(n))
    bench = [(i, sentence(rng.choice([0, 1, 3, 4, 5, 8]))) for i in range(30)] + [(3, "the the"), (None, "zz zz zz zz"), (40, None)]
    docs = [(i, sentence(rng.randint(0, 40))) for i in range(150)] + [(7, None), (8, ""), (9, bench[2][1]), (None, bench[5][1])]
    ws = Workspace(spark, "test")
    index = ws.save(decontaminate.index(spark.createDataFrame(docs, SCHEMA)), "i")
    got = decontaminate.search(index, spark.createDataFrame(bench, "item_id long, text string"), 4, limit).collect()
    assert Counter(tuple(r)[:6] for r in got) == python_hits(docs, bench, 4)
    assert all(sum(z - a for a, z in zip(r.spans[::2], r.spans[1::2], strict=True)) >= r.n_hit for r in got)


def test_near_matches():
    data, off = T.buffers(pa.array(["a x b y c", "c b a", "a b"]))
    row, _ = decontaminate.words(data, off)
    assert np.bincount(row).tolist() == [5, 3, 2]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(["a x b y c", "c b a", "a b"])], ["doc_id", "text"])

    class Context:
        def partitionId(self):  # noqa: N802
            return 0

    import pyspark

    real = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: Context())
    try:
        segment = decontaminate.Segment(next(iter(decontaminate._index([batch]))).to_pylist()[0])
    finally:
        pyspark.TaskContext.get = real
    query = decontaminate.Query([("1", "a b c")])
    query.rank({})
    places = segment.places(query.terms)[query.windows[0]]
    assert segment.doc(segment.near(places, query.order[0], 2)).tolist() != []
    assert set(segment.doc(segment.near(places, query.order[0], 2)).tolist()) == {0, 1} or set(segment.doc(segment.near(places, query.order[0], 4)).tolist()) == {0, 1}
    assert len(segment.phrase(places, query.order[0])) == 0


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(edges, bench).collect()}
    assert got[10].contaminated and not got[5].contaminated and got[1].n_words == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(edges, bench.filter("item_id > 1")).collect())


def test_varint():
    x = np.array([0, 1, 127, 128, 300, 2**20, 2**34], np.int64)
    assert decontaminate.from_varint(decontaminate.to_varint(x)[0]).tolist() == x.tolist()


# Substrings


def python_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "window", "gram"), [(40, 8, 4), (40, 24, 8), (30, 10, 6)])
def test_substrings(spark, length, window, gram):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [make(rng.randint(0, 200)) for _ in range(50)]
    docs = list(base)
    for _ in range(50):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = "é"
        docs.append("".join(t))
    docs += [rng.choice(base)[: rng.randint(0, 80)] + make(20) + rng.choice(base)[rng.randint(0, 50) :] for _ in range(20)]
    docs += ["a" * 100, "ab" * 50, "ab" * 30, None, "", *[base[0]] * 3]
    rows = [*enumerate(docs), (5, docs[5]), (None, docs[6])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)), length, window, gram).collect()
    assert Counter(tuple(r)[:5] for r in got) == python_repeats(rows, length)


def test_substring_edges(spark, edges, empty):
    got = substrings.remove_repeats(edges).collect()
    assert Counter(tuple(r)[:5] for r in got) == python_repeats(EDGES, 400)
    assert substrings.remove_repeats(empty).count() == 0


def test_samples_of_many_texts_at_once():
    """As each text alone gives them; short and empty texts, and texts that end as the next begins."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 30, 100, 39, 40, 41, 0, 700, 5, 64)]
    texts += [np.full(90, 97, np.uint8), np.full(200, 97, np.uint8), texts[7], texts[7][:300], np.empty(0, np.uint8)]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    for window, gram in ((8, 4), (24, 8), (22, 4)):
        row, shape, bucket = substrings.samples(np.concatenate(texts), off, 40, window, gram)
        for i, t in enumerate(texts):
            want = substrings._samples(t, 40, window, gram) if len(t) >= 40 else ([], [])
            assert shape[row == i].tolist() == list(want[0]) and bucket[row == i].tolist() == list(want[1])


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 6000).astype(np.uint8)
    whole = substrings.anchors(data, T.prefix_hash(data), 100, 16)
    monkeypatch.setattr(substrings, "_POSITION", 11)
    for a, b in zip(whole, substrings.anchors(data, T.prefix_hash(data), 100, 16), strict=True):
        assert len(a) == len(b)


# Pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        ws = Workspace(spark, "stage")
        out = ws.save(stage(spark, docs, data), "out")
        if k < 4:
            assert out.columns == names and 0 < out.count() <= docs.count()
            docs = out
    packed = {r.doc_id for r in out.collect()}
    assert packed == {r.doc_id for r in docs.collect()}
    assert pipeline.run(spark, data).count() == out.count()


def stage(name, spark, rows, data, columns="doc_id long, text string, lang string, source string, n_chars long"):
    import corpus_pipeline as pipeline

    docs = Workspace(spark, "stage").save(spark.createDataFrame(rows, columns), "in")
    return dict(pipeline.STAGES)[name](spark, docs, data)


def jaccard5(a, b):
    sets = []
    for t in (a, b):
        w = lower((t or "").encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_near_dedup_stage(spark, data):
    """Of each component of pairs at 0.8 or more the smallest id stays, for repeated and null ids, too."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(30):
        text = [word() for _ in range(150)]
        rows.append((3 * g, " ".join(text), None, "s", 1))
        text[70] = word()
        rows.append((3 * g + 1, " ".join(text), None, "s", 1))
    same = rows[0][1]
    rows += [(2, same, None, "s", 1), (2, "some other text of this id here now", None, "s", 1), (None, same, None, "s", 1), (None, same, None, "s", 1), (0, same, None, "s", 1)]
    kept = Counter((r.doc_id, r.text) for r in stage("near_dedup", spark, rows, data).collect())
    left = set(range(len(rows)))
    want = Counter()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                group.add(x)
                todo += [y for y in left if jaccard5(rows[x][1], rows[y][1]) >= 0.8]
        first = min(group, key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
        want[rows[first][:2]] += 1
    assert kept == want


def test_line_and_language_stages_keep_other_columns(spark, data):
    docs = [(1, "one line\nanother line", "en", "s", 21, "k", 77), (2, "one line\nthird", "en", "s", 14, "k", 77), (None, "third", "en", "s", 5, "k", 77), (4, None, None, "s", 0, "k", 77)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, {} string, {} int"
    got = [tuple(r) for r in stage("line_dedup", spark, docs, data, columns.format("kept", "n_lines")).collect()]
    assert sorted(got, key=str) == sorted([docs[0], (2, "third", "en", "s", 5, "k", 77), docs[3]], key=str)
    for names in (("key", "cuts"), ("score", "rejected"), ("_key", "contaminated")):
        for name in ("language_id", "line_dedup", "near_dedup", "decontaminated"):
            out = stage(name, spark, docs, data, columns.format(*names))
            assert out.columns[-2:] == list(names) and all((r[-2], r[-1]) == ("k", 77) for r in out.collect())


def test_decontaminated_stage(spark, data):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(None, bench[0][1], None, None, 1), (7, bench[0][1], None, None, 1)]
    clean = {r[0] for r in python_hits([(i, r[1]) for i, r in enumerate(docs)], bench, 10) if not r[5]}
    assert Counter(tuple(r) for r in stage("decontaminated", spark, docs, data).collect()) == Counter(docs[i] for i in clean)


def test_pipeline_edges(spark, data):
    import corpus_pipeline as pipeline

    rows = [(i, t, None, None, None) for i, t in EDGES] + [(20, "word " * 60, "en", "s", 300), (21, "word " * 60, "en", "s", 300)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        ws = Workspace(spark, "stage")
        docs = ws.save(stage(spark, docs, data), "out")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
