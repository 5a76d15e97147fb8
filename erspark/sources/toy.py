"""Generated records with known matches, from ids and hashes alone.

Every column is a function of the id and a seed, so the tables are the same for any
partitioning and any part of them can be made on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of the generated names and addresses.
STEMS = ["apex", "blue", "cedar", "delta", "eagle", "falcon", "green", "harbor", "iron", "jade", "kings", "lotus", "maple", "nova", "orion", "pearl", "quartz", "river", "silver", "tiger", "union", "vista", "willow", "zenith"]
TRADES = ["traders", "foods", "textiles", "motors", "pharma", "consulting", "logistics", "printers", "jewellers", "electronics", "builders", "studios"]
SUFFIXES = ["private limited", "llc", "inc", "limited", "company", ""]
STREETS = ["main", "station", "market", "church", "lake", "park", "garden", "mill"]
KINDS = ["road", "street", "avenue", "lane"]
PLACES = {"US": ["texas", "new york", "ohio", "north carolina"], "India": ["maharashtra", "tamil nadu", "kerala", "delhi"]}
NATIVE = {"apex": "एपेक्स", "lotus": "लोटस", "tiger": "टाइगर", "foods": "फूड्स", "motors": "मोटर्स", "private": "प्राइवेट", "limited": "लिमिटेड"}


def draw(key: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")


def pick(values: list[str], key: Column, salt: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(key, salt, len(values)))


def entities(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(e, country, name, street, number, place, zip, k): the true businesses."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    key = F.concat_ws(":", F.col("id"), F.lit(seed))
    # A quarter of the names are those of an earlier business.
    own = F.when(draw(key, "namesake", 4) == 0, F.concat_ws(":", F.floor(F.col("id") / 7), F.lit(seed))).otherwise(key)
    country = F.when(draw(key, "country", 2) == 0, "US").otherwise("India")
    place = F.when(country == "US", pick(PLACES["US"], key, "place")).otherwise(pick(PLACES["India"], key, "place"))
    return ids.select(
        F.col("id").alias("e"), country.alias("country"),
        F.trim(F.concat_ws(" ", pick(STEMS, own, "a"), pick(STEMS, own, "b"), pick(TRADES, own, "t"), pick(SUFFIXES, own, "s"))).alias("name"),
        F.concat_ws(" ", pick(STREETS, key, "st"), pick(KINDS, key, "kind")).alias("street"),
        (draw(key, "no", 1500) + 1).alias("number"), place.alias("place"), (draw(key, "zip", 899_999) + 100_000).alias("zip"),
        F.get(F.array(*[F.lit(x) for x in (0, 1, 2, 2, 3, 3, 4, 4, 5, 8)]), draw(key, "k", 10)).alias("k"),
    )


def _address(number: Column) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", number, F.col("street")), F.col("place"), F.col("zip").cast("string"))


def source1(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("S1-"), F.col("e")).alias("entity_id"), F.initcap("name").alias("business_name"), _address(F.col("number").cast("string")).alias("business_address"), "country")


def copies(e: DataFrame, distractors: float = 0.35, seed: int = 0) -> DataFrame:
    """(copy, e, owned, src, business_name, business_address, country): noisy records of entities.

    Noise: typo, native script, shuffled words, a dropped suffix, a domain, a phone
    number; padded or marked house numbers, shuffled, cut or empty addresses.
    """
    rows = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("key", F.concat_ws(":", "e", "j", F.lit(seed)))
    rows = rows.withColumn("owned", F.col("j") > 0).filter(F.col("owned") | (draw(F.col("key"), "extra", 100) < int(distractors * 100) * 2))
    key, name = F.col("key"), F.col("name")
    at = draw(key, "at", 8) + 1
    typo = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)))
    words = F.split(name, " ")
    shuffled = F.array_join(F.concat(F.slice(words, 2, 100), F.slice(words, 1, 1)), " ")
    native = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NATIVE.items() for x in kv]), w), w)), " ")
    noisy = (
        F.when(draw(key, "noise", 10) == 0, typo)
        .when(draw(key, "noise", 10) == 1, shuffled)
        .when(draw(key, "noise", 10) == 2, F.substring_index(name, " ", 3))
        .when(draw(key, "noise", 10) == 3, F.concat(F.lit("www."), F.replace(name, F.lit(" "), F.lit("")), F.lit(".com")))
        .when(draw(key, "noise", 10) == 4, F.concat(name, F.lit(" 98"), (draw(key, "phone", 89_999_999) + 10_000_000).cast("string")))
        .when((F.col("country") == "India") & (draw(key, "script", 10) < 4), native)
        .otherwise(F.upper(name))
    )
    number = F.col("number") + F.when(F.col("owned"), F.lit(0)).otherwise(draw(key, "other", 300) + 1)
    marked = F.when(draw(key, "mark", 4) == 0, F.concat(F.lit("0"), number)).when(draw(key, "mark", 4) == 1, F.concat(F.lit("#"), number)).when(draw(key, "mark", 4) == 2, F.concat(number, F.lit("-B"))).otherwise(number.cast("string"))
    full = _address(marked)
    address = F.when(draw(key, "addr", 100) < 3, "").when(draw(key, "addr", 100) < 20, F.substring_index(full, ",", 1)).when(draw(key, "addr", 100) < 35, F.concat_ws(", ", F.col("place"), F.concat_ws(" ", marked, F.col("street")))).otherwise(full)
    src = F.when(draw(key, "src", 2) == 0, "S2").otherwise("S3")
    return rows.select(key.alias("copy"), "e", "owned", src.alias("src"), F.concat(src, F.lit("-"), F.replace(key, F.lit(":"), F.lit("_"))).alias("entity_id"), noisy.alias("business_name"), address.alias("business_address"), "country")


def truth(e: DataFrame, pool: DataFrame) -> DataFrame:
    lists = pool.filter("owned").groupBy("e").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("ids"))
    return e.join(lists, "e", "left").select(F.concat(F.lit("S1-"), F.col("e")).alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def tables(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    """source1, source2, source3 and truth of n businesses."""
    e = entities(spark, n, seed)
    pool = copies(e, seed=seed)
    raw = ["entity_id", "business_name", "business_address", "country"]
    return {"source1": source1(e), "source2": pool.filter("src = 'S2'").select(*raw), "source3": pool.filter("src = 'S3'").select(*raw), "truth": truth(e, pool)}
