"""Normalisation of business names and addresses as column expressions.

Levels: 0 lower case and single spaces; 1 clean-up, accent folding, tokens; 2 Indic
scripts to Latin; 3 learned dictionary before that; 4 canonical words.

Everything runs in the JVM but the Unicode steps (compatibility forms, Indic scripts,
accents beyond Latin): ``unicode_steps`` does those in one Arrow batch function, for the
tables that need them. Latin text gives the same result without it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import maps

INDIC = "\\u0900-\\u0D7F"
#: All but ASCII digits, small letters and Indic script, as ranges: the negated class takes Java several times as long.
BETWEEN = r"[\x00-/:-`{-\u08FF\u0D80-\x{10FFFF}]+"
_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšťùúûüūůűýÿźżž"
#: Letters with a canonical decomposition, to their base letter.
_FOLDABLE = "".join(c for c in _ACCENTED if len(unicodedata.normalize("NFKD", c)) > 1)
_FOLDED = "".join(unicodedata.normalize("NFKD", c)[0] for c in _FOLDABLE)


def table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(entries.items()) for x in kv])


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def has_indic(c: Column) -> Column:
    return c.rlike(f"[{INDIC}]")


def fold_latin(c: Column) -> Column:
    """Accents off Latin letters in lower case."""
    return F.translate(c, _FOLDABLE, _FOLDED)


def indic_runs(c: Column) -> Column:
    """Runs of Indic script, joiners removed."""
    found = F.regexp_extract_all(c, F.lit(f"[{INDIC}\\u200C\\u200D]+"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[\\u200B-\\u200F\\uFEFF]", "")), lambda x: x != "")


def zero_strip(token: Column) -> Column:
    bare = F.ltrim(token, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def skeleton(token: Column) -> Column:
    """Consonants after phonetic merges, the first letter kept, repeats collapsed; digits unchanged."""
    t = token
    for a, b in maps.PHONETIC:
        t = F.replace(t, F.lit(a), F.lit(b))
    bare = F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "[aeiouy]", ""))
    return F.when(token.rlike(r"(?U)^\d+$"), token).otherwise(F.regexp_replace(bare, r"(.)\1+", "$1"))


def split_alnum(c: Column) -> Column:
    """A space between digits and letters, but not before an ordinal's ending."""
    return F.regexp_replace(c, r"(?U)(?<=\d)(?=(?!(?:st|nd|rd|th)\b)[a-z])|(?<=[a-z])(?=\d)", " ")


def join_singles(c: Column) -> Column:
    """Single letters in a row become one token."""
    return F.regexp_replace(c, r"(?<=^[a-z]|[ ][a-z]) (?=[a-z](?: |$))", "")


def drop_repeats(c: Column) -> Column:
    """A token that repeats the one before it goes."""
    return F.regexp_replace(c, r"(?<=^|[ ])(\S+)(?: \1)+(?= |$)", "$1")


def url_domain(c: Column) -> Column:
    """URLs and host names become the name before the top domain."""
    return F.regexp_replace(c, rf"(?U)\b(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:{'|'.join(maps.TOP_DOMAINS)})\b", " $1 ")


def clean(c: Column, field: str) -> Column:
    """Marks, number signs, URLs, phones and null words; c is in lower case."""
    s = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit("")), F.lit("’"), F.lit(""))
    s = url_domain(F.regexp_replace(s, r"(?U)\bn\s*[°º]", " no "))
    if field == "name":
        s = F.regexp_replace(F.regexp_replace(s, r"(?U)\b\d{8,}\b", " "), r"(?U)#\s*\d+", " ")
    return F.regexp_replace(s, r"(?U)<\s*null\s*>|\bnull\b", " ")


def tokens(c: Column) -> Column:
    """Space-joined tokens of cleaned and folded text."""
    parts = F.filter(F.split(split_alnum(c), BETWEEN), lambda t: t != "")
    parts = F.transform(parts, lambda t: F.when(t.rlike(r"(?U)^\d+$"), zero_strip(t)).otherwise(t))
    return drop_repeats(join_singles(F.array_join(parts, " ")))


def canon_name(c: Column) -> Column:
    words, legal = table(maps.NAME_WORDS), table(maps.LEGAL_SKELETONS)

    def one(t):
        by_sound = F.when((F.length(t) >= 5) & t.rlike(r"^[a-z]+$"), F.element_at(legal, skeleton(t)))
        return F.coalesce(F.element_at(words, t), by_sound, t)

    return F.array_join(F.transform(_split(c), one), " ")


def canon_address(c: Column, country: Column) -> Column:
    """Region names to codes (longest first), marker words dropped, then word forms."""
    out = _address_words(c, {}, False)
    for name, states in maps.STATES.items():
        out = F.when(country == name, _address_words(c, states, name == "France")).otherwise(out)
    return out


def _address_words(c: Column, states: dict[str, str], french: bool) -> Column:
    s = c
    for phrase in sorted((p for p in states if " " in p), key=len, reverse=True):
        s = F.regexp_replace(s, rf"\b{phrase}\b", states[phrase])
    dropped = strings(*maps.ADDRESS_DROPPED, *(maps.FRENCH_DROPPED if french else []))
    kept = F.filter(_split(s), lambda t: ~F.array_contains(dropped, t))
    forms = table(maps.ADDRESS_WORDS | {k: v for k, v in states.items() if " " not in k})
    out = F.transform(kept, lambda t: F.coalesce(F.element_at(forms, t), t))
    if french:
        more = table(maps.FRENCH_WORDS)
        out = F.transform(out, lambda t: F.coalesce(F.element_at(more, t), t))
    return F.array_join(out, " ")


def _split(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def lowered(c: Column) -> Column:
    """Zero-width marks off, lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u200B-\\u200F\\uFEFF]", ""))


def normalize(c: Column, level: int = 4, field: str = "name", country: Column | None = None, prepared: bool = False) -> Column:
    """Normal form at a level. prepared: ``unicode_steps`` has run on the lowered text."""
    s = c if prepared else lowered(c)
    if level <= 0:
        return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    s = tokens(clean(s, field) if prepared else fold_latin(clean(s, field)))
    if level >= 4:
        s = canon_name(s) if field == "name" else canon_address(s, country if country is not None else F.lit(None).cast("string"))
    return s


# Latin for the common layout of the Indic blocks, by place in the block.
_VOWELS = dict(zip(range(0x05, 0x15), ["a", "aa", "i", "ii", "u", "uu", "r", "l", "e", "e", "e", "ai", "o", "o", "o", "au"], strict=True))
_CONSONANTS = dict(
    zip(
        range(0x15, 0x3A),
        ["k", "kh", "g", "gh", "n", "c", "ch", "j", "jh", "n", "t", "th", "d", "dh", "n", "t", "th", "d", "dh", "n", "n", "p", "ph", "b", "bh", "m", "y", "r", "r", "l", "l", "l", "v", "sh", "s", "s", "h"],
        strict=True,
    )
)
_SIGNS = dict(zip(range(0x3E, 0x4D), ["aa", "i", "ii", "u", "uu", "r", "r", "e", "e", "e", "ai", "o", "o", "o", "au"], strict=True))


def transliterate(run: str) -> str:
    """Latin for a run of any Indic script, by the layout that the blocks share."""
    out = []
    for i, ch in enumerate(run):
        at, following = ord(ch) & 0x7F, ord(run[i + 1]) & 0x7F if i + 1 < len(run) else None
        if at in _CONSONANTS:
            silent = following is None or following == 0x4D or following in _SIGNS
            out.append(_CONSONANTS[at] + ("" if silent else "a"))
        elif at in _VOWELS:
            out.append(_VOWELS[at])
        elif at in _SIGNS:
            out.append(_SIGNS[at])
        elif at in (0x01, 0x02):
            out.append("n")
        elif 0x66 <= at <= 0x6F:
            out.append(str(at - 0x66))
    return "".join(out)


def fold_all(s: str) -> str:
    """Accents off all but Indic characters, whose marks carry meaning."""
    if s.isascii():
        return s
    return "".join(c if "ऀ" <= c <= "ൿ" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in s)


def unicode_steps(field: str = "name", level: int = 4, dictionary: dict[str, dict[str, str]] | None = None):
    """Arrow batch function for lowered text: compatibility forms, Indic runs, accents.

    Other scripts stand for themselves until their marks go with the token split. Run it
    on distinct values, as ``normalize_table`` does.
    """
    import re

    runs = re.compile("[ऀ-ൿ‌‍]+")
    first = (dictionary or {}).get(field, {})
    second = (dictionary or {}).get("addr" if field == "name" else "name", {})

    def one(s: str) -> str:
        if s is None or s.isascii():
            return s
        s = unicodedata.normalize("NFKC", s)
        if level >= 2:

            def latin(m):
                run = m[0].replace("‌", "").replace("‍", "")
                known = first.get(run) or second.get(run) if level >= 3 else None
                return f" {known or transliterate(run)} "

            s = runs.sub(latin, s)
        return fold_all(s)

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(one)

    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "string")


def normalize_table(df: DataFrame, column: str, out: str, level: int = 4, field: str = "name", country: str | None = None, dictionary: dict | None = None) -> DataFrame:
    """Adds the normal form of a column with all Unicode steps, worked out once per distinct value and country."""
    keys = [column] + ([country] if country else [])
    ready = df.select(*keys).distinct().withColumn("_low", unicode_steps(field, level, dictionary)(lowered(F.col(column))))
    normal = ready.withColumn(out, normalize(F.col("_low"), level, field, F.col(country) if country else None, prepared=True))
    joined = df.alias("d").join(normal.alias("n"), [F.col(f"d.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left")
    return joined.select("d.*", f"n.{out}")


def numbers(c: Column) -> Column:
    """Distinct digit runs of raw text, leading zeros off, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\d+"), F.lit(0)), zero_strip))


def first_number(c: Column) -> Column:
    """The first digit run without leading zeros, or ''."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)\d+", 0)
    return F.when(found == "", F.lit("")).otherwise(zero_strip(found))


def zips(c: Column) -> Column:
    """Distinct runs of five or six digits; 'ddd ddd' counts as six."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?<!\d)(\d{3}) (\d{3})(?!\d)", "$1$2")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(?U)(?<!\d)(\d{5,6})(?!\d)"), F.lit(1)))


def components(c: Column, level: int = 4, country: Column | None = None) -> Column:
    """Normal forms of the parts between commas, empty and repeated ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: normalize(x, level, "addr", country)), lambda x: x != ""))


def words(c: Column) -> Column:
    return _split(c)


def core(c: Column) -> Column:
    """Tokens of a normal name that say something, or all if none does."""
    generic = strings(*maps.GENERIC_NAME)
    telling = F.filter(_split(c), lambda t: ~F.array_contains(generic, t))
    return F.when(F.size(telling) > 0, telling).otherwise(_split(c))


def core_name(c: Column) -> Column:
    return F.array_join(core(c), " ")


def joint_text(name: Column, address: Column) -> Column:
    """'name , address', or the name alone."""
    return F.when(F.coalesce(address, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" , "), address))


def pair_text(name: Column, address: Column) -> Column:
    return F.concat(name, F.lit(" | "), F.coalesce(address, F.lit("")))


def profile_words(c: Column) -> Column:
    """The profile's own normal form: accents off everywhere, marks to spaces; Latin text."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_latin(F.lower(F.coalesce(c, F.lit("")))), r"[^\w\s]", " "), r"\s+", " "))


def fold_of(key: Column, n: int = 5) -> Column:
    """A stable fold of an id."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
