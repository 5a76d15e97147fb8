"""Document fingerprints from closed syncmers over words, with DataFrame functions only.

A k-mer of ``K`` words is kept if its smallest inner ``S``-mer, by hash, is its first or
last one. The choice depends on the k-mer alone, so an edit changes only the anchors that
touch it. A fingerprint has every anchor of the whole text in the order of the text: its
32-bit hash and its distance in words from the anchor before it (``K - S`` at most, by the
window guarantee of closed syncmers). Anchors match by hash and relative place, wherever the
passage stands; the likeness of two fingerprints is the share of their different anchors
that are in both. ``anchors`` and ``same_place`` give and match absolute places.

Words are runs of letters, marks and digits in lower case; letters of scripts without
spaces are words of their own. In texts without a closed syncmer (fewer than ``K`` words,
say) every word is an anchor; a text without words has one, the hash of all of it. Null is empty. Repeated rows have a
place each in the order of ids, null ids last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import literal_rows, partitions, range_bounds, range_bucket

K, S = 5, 2

_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]+|[{_ALONE}]"


def word_list(text):
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _inner(words):
    """Hashes of the S-mers (S = 2)."""
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)))).otherwise(F.array().cast("array<bigint>"))


def _closed(inner):
    """(place, hash) of closed syncmers; null elsewhere."""
    span = K - S

    def one(i):
        first, last = F.get(inner, i), F.get(inner, i + span)
        least = F.least(*[F.get(inner, i + j) for j in range(span + 1)])
        return F.when((first == least) | (last == least), F.struct(i.alias("place"), F.xxhash64(first, F.get(inner, i + 2), last).alias("hash")))

    places = F.when(F.size(inner) > span, F.sequence(F.lit(0), F.size(inner) - span - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, one), lambda x: x.isNotNull())


def _add(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text column; steps are columns of their own, so each runs once."""
    w, s = f"_{out}_w", f"_{out}_s"
    df = df.withColumn(w, word_list(F.col(text))).withColumn(s, _inner(F.col(w))).withColumn(out, _closed(F.col(s)))
    short = F.transform(F.col(w), lambda x, i: F.struct(i.alias("place"), F.xxhash64(x).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(F.col(text), F.lit(1)).alias("hash")))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).when(F.size(w) > 0, short).otherwise(whole)).drop(w, s)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (first word), hash of every closed syncmer of whole texts."""
    found = _add(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "found")
    # The outer form keeps a filter on the anchors, and with it their steps, from being worked out again per row.
    return found.select("doc_id", F.inline_outer("found"))


def _low(x):
    return x["hash"].bitwiseAND(F.lit(0xFFFFFFFF))


def _sketch(found):
    """One long per anchor, in the order of the text: words since the anchor before (1 for a first one at place 0), then 32 bits of hash."""
    gap = lambda x, i: (x["place"] - F.when(i > 0, F.get(found, i - 1)["place"]).otherwise(F.lit(-1))).cast("bigint")
    return F.transform(found, lambda x, i: F.shiftleft(gap(x, i), 32).bitwiseOR(_low(x)))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a fingerprint (anchors in order) of a text column, and as ``<out>_at`` its anchors with absolute places."""
    at = F.transform(f"_{out}", lambda x: F.shiftleft(x["place"].cast("bigint"), 32).bitwiseOR(_low(x)))
    return _add(df, text, f"_{out}").withColumn(out, _sketch(F.col(f"_{out}"))).withColumn(f"{out}_at", at).drop(f"_{out}")


def as_string(sketch):
    """Nine hex digits per anchor: distance, hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 9, "0"))), "")


def likeness(a, b):
    """Share of the different anchors of both that are in each, by hash and relative place; 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def same_place(a, b):
    """Number of anchors that stand at the same absolute place in both (``_at`` columns)."""
    return F.size(F.array_intersect(a, b)).cast("bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_sketch, of the next row by descending doc_id; the first follows the last.

    Rows are dealt to ranges of ids by constant bounds and ordered there; the first row
    of a range also goes to the range before it as a ghost.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(base.select("doc_id"), "doc_id", 4 * partitions(spark))
    base = base.withColumn("part", range_bucket("doc_id", bounds))
    # One row per range, of which there are four times the shuffle partitions at most.
    tops = sorted((r["part"], r["top"]["doc_id"], r["top"]["tie"]) for r in base.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("top")).collect())
    ghosts = [{"part": p, "top_id": d, "top_tie": t, "to": tops[(i + 1) % len(tops)][0]} for i, (p, d, t) in enumerate(tops)]
    heads = literal_rows(spark, ghosts, "part: int, top_id: bigint, top_tie: bigint, to: int")
    marked = base.join(F.broadcast(heads), "part")
    is_head = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie"))
    home = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    dealt = marked.withColumn("at", F.explode(F.when(is_head, F.array(home, F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost")))).otherwise(F.array(home))))
    dealt = dealt.select("doc_id", "text", "tie", F.col("at.part").alias("part"), F.col("at.ghost").alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    sketched = fingerprint(dealt.repartition("part"), "text", "sketch")
    follow = F.lead(F.struct("text", "sketch")).over(order)
    return sketched.withColumn("next", follow).filter("not ghost").select("doc_id", "text", "sketch", "sketch_at", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints and likenesses of texts, edited texts and next texts;
    n_anchors, and n_in_place: those that stand at the same place in the edited text."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = fingerprint(pairs, "edited", "edited_sketch")
    return pairs.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").cast("bigint").alias("n_anchors"), same_place(F.col("sketch_at"), F.col("edited_sketch_at")).alias("n_in_place"),
    )
