"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte 2- and 3-grams; every language has
several centroids from spherical k-means. The nearest by cosine gives the language. A
text far from all of them, for its length, is rejected.

The classifier is fitted on at most ``SAMPLE`` labelled texts in all, chosen by a hash
of their text. Predictions use the text alone, whole. Null texts and texts without a
letter are ``und`` with score 0, and rejected; with no training rows all texts are.
Null labels are not learned; repeated rows are predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .store import ship

#: Labelled texts that the classifier is fitted on, over all languages.
SAMPLE = 2000
CENTROIDS = 3
#: Hash buckets of each gram size.
BUCKETS = 4096
#: Rejected: under this share of the least usual similarity of training texts of like length.
REJECT = 0.3
#: Texts with fewer grams have too little evidence to be rejected by distance.
ENOUGH = 64

_KEEP = np.full(256, 32, np.uint8)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gram counts, a row per text: letters in lower case, the rest one space."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    x = _KEEP[data]
    space = x == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(x):
        keep[0] = True
    x, row = x[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * 2 * BUCKETS, np.int64)
    if len(x) > 1:
        two = x[:-1] << np.uint32(8) | x[1:]
        same = row[:-1] == row[1:]
        shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
        at = row[:-1] * (2 * BUCKETS) + ((two * np.uint32(2654435761)) >> shift)
        out += np.bincount(at[same], minlength=len(out))
        if len(x) > 2:
            three = two[:-1] << np.uint32(8) | x[2:]
            same = row[:-2] == row[2:]
            at = row[:-2] * (2 * BUCKETS) + BUCKETS + ((three * np.uint32(2246822519)) >> shift)
            out += np.bincount(at[same], minlength=len(out))
    return out.reshape(n, -1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (_KEEP[data] != 32) & (data < 128)
    seen = np.append(0, np.cumsum(ascii_letter))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    wide = np.append(0, np.cumsum(data >= 128))
    for i in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    #: Least similarity that is accepted, by the base-2 logarithm of the number of grams.
    floor: np.ndarray

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        v = np.log1p(counted.astype(np.float32)) * self.idf
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def nearest(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected)."""
        cosine = np.clip(self.vectors(counted) @ self.centroids.T, 0, 1)
        best = cosine.argmax(1)
        score = cosine[np.arange(len(best)), best]
        return self.of[best], score, score < self.floor[_length_class(counted)]


def _length_class(counted: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counted.sum(1) + 1).astype(np.int64), 31)


def _sparse(batches):
    for b in batches:
        data, off = T.buffers(b.column("text"))
        out = []
        for lo, hi in T.slices(off, T.SLICE_BYTES // 4):
            for a in range(lo, hi, 64):
                z = min(hi, a + 64)
                for row in counts(data[off[a] : off[z]], off[a : z + 1] - off[a]):
                    at = np.flatnonzero(row)
                    out.append(at.astype("<u2").tobytes() + np.minimum(row[at], 65535).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.binary())], ["lang", "h", "grams"])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int((v @ v.mean(0)).argmax())]
    while len(seeds) < min(k, len(v)):
        seeds.append(int((v @ v[seeds].T).max(1).argmin()))
    c = v[seeds]
    for _ in range(rounds):
        of = (v @ c.T).argmax(1)
        c = np.stack([v[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model | None:
    """A model of (text, lang) rows; None if none has both."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    least = F.coalesce(F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("h"))), F.min("h"))
    sizes = {r["lang"]: r for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), least.alias("least")).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    # A hash bound per language keeps about ``each`` of its distinct texts, however often they repeat, and its least hash.
    share = {name: 1.25 * each / max(1, r["n"]) for name, r in sizes.items()}
    cut = spark.createDataFrame([(name, max(sizes[name]["least"], int(-(2**63) + b * (2**64 - 1) - 1)) if b < 1 else 2**63 - 1) for name, b in share.items()], "lang string, bound long")
    some = hashed.join(F.broadcast(cut), "lang").filter("h <= bound").dropDuplicates(["lang", "h"])
    found = sorted(some.select("lang", "h", "text").mapInArrow(_sparse, "lang string, h long, grams binary").collect(), key=lambda r: (r["lang"], r["h"]))
    names, taken, kept = sorted(sizes), dict.fromkeys(sizes, 0), []
    for r in found:
        if taken[r["lang"]] < each and r["grams"]:
            taken[r["lang"]] += 1
            kept.append(r)
    names = [x for x in names if taken[x]]
    if not names:
        return None
    counted = np.zeros((len(kept), 2 * BUCKETS), np.uint16)
    for i, r in enumerate(kept):
        at, n = np.frombuffer(r["grams"], "<u2").reshape(2, -1)
        counted[i, at] = n
    own = np.array([names.index(r["lang"]) for r in kept])
    idf = (np.log((1 + len(kept)) / (1 + (counted > 0).sum(0))) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((0, 2 * BUCKETS), np.float32), np.zeros(0, np.int64), np.zeros(32))
    v = model.vectors(counted)
    groups = [cluster(v[own == j], k) for j in range(len(names))]
    model.centroids = np.concatenate(groups).astype(np.float32)
    model.of = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    sims = np.where(model.of[None, :] == own[:, None], v @ model.centroids.T, 0).max(1)
    size, low = _length_class(counted), 1.0
    for c in range(31, -1, -1):  # shorter texts are never asked for more than longer ones
        if (size == c).sum() >= 5:
            low = min(low, float(np.quantile(sims[size == c], 0.01)))
        model.floor[c] = REJECT * low
    model.floor[: int(np.log2(ENOUGH + 1)) + 1] = 0.0
    return model


def _predict(model: Model | None):
    def run(batches):
        T.keep("", {})
        for b in batches:
            text = b.column("text")
            data, off = T.buffers(text)
            lang, score, rejected = [], [], []
            for lo, hi in T.slices(off, T.SLICE_BYTES // 4):
                for a in range(lo, hi, 64):
                    z = min(hi, a + 64)
                    d, o = data[off[a] : off[z]], off[a : z + 1] - off[a]
                    ok = has_letter(d, o)
                    if model is None:
                        best, s, far = np.zeros(z - a, np.int64), np.zeros(z - a), np.ones(z - a, bool)
                        ok[:] = False
                    else:
                        best, s, far = model.nearest(counts(d, o))
                    lang += [model.languages[j] if y else "und" for j, y in zip(best.tolist(), ok.tolist(), strict=True)]
                    score += np.where(ok, s, 0.0).tolist()
                    rejected += (far | ~ok).tolist()
            out = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            names = [n for n in b.schema.names if n not in out]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *out.values()], [*names, *out])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, which have a text column, with lang_pred, score and rejected (replaced if there)."""
    ship(docs.sparkSession)
    base = docs.drop("lang_pred", "score", "rejected")
    schema = StructType(list(base.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return base.mapInArrow(_predict(model), schema)
