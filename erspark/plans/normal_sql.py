"""DuckDB SQL for the text steps, written with lists where Spark uses lookarounds."""

from __future__ import annotations

from ..functions import maps
from .views import with_views


def sql_map(entries: dict[str, str]) -> str:
    keys, values = zip(*sorted(entries.items()), strict=True)
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"MAP({quote(keys)}, {quote(values)})"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def collapse(s: str) -> str:
    """Runs of one character become one."""
    chars = f"string_split({s}, '')"
    return f"array_to_string(list_filter({chars}, lambda ch, ix: ix = 1 OR ch <> {chars}[ix - 1]), '')"


def skeleton(t: str) -> str:
    s = t
    for a, b in maps.PHONETIC:
        s = f"replace({s}, '{a}', '{b}')"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN {t} ELSE {collapse(f"concat(substr({s}, 1, 1), regexp_replace(substr({s}, 2), '[aeiouy]', '', 'g'))")} END"


def normal_ctes(level: int = 4, base: str = "SELECT doc_id AS id, country, name, addr FROM txt_all") -> str:
    """CTEs up to ``norm`` (id, country, name, addr, nname, naddr), for Latin text."""
    domains = "|".join(maps.TOP_DOMAINS)
    canon_name = f"list_transform(toks, lambda t: coalesce({sql_map(maps.NAME_WORDS)}[t], CASE WHEN length(t) >= 5 AND regexp_full_match(t, '[a-z]+') THEN {sql_map(maps.LEGAL_SKELETONS)}[{skeleton('t')}] END, t))"
    canon_addr = f"list_transform(list_filter(toks, lambda t: NOT list_contains({sql_list(maps.ADDRESS_DROPPED)}, t)), lambda t: coalesce({sql_map(maps.ADDRESS_WORDS)}[t], t))"
    final = f"CASE WHEN field = 'name' THEN array_to_string({canon_name}, ' ') ELSE array_to_string({canon_addr}, ' ') END" if level >= 4 else "array_to_string(toks, ' ')"
    return f"""
base AS ({base}),
long AS (SELECT id, 'name' AS field, coalesce(name, '') AS s FROM base UNION ALL SELECT id, 'addr', coalesce(addr, '') FROM base),
c1 AS (SELECT id, field, replace(replace(replace(lower(s), '&', ' and '), '''', ''), '’', '') AS s FROM long),
c2 AS (SELECT id, field, regexp_replace(regexp_replace(s, '\\bn\\s*[°º]', ' no ', 'g'), '\\b(?:https?://)?(?:www\\.)?([a-z0-9\\-]+)\\.(?:{domains})\\b', ' \\1 ', 'g') AS s FROM c1),
c3 AS (SELECT id, field, CASE WHEN field = 'name' THEN regexp_replace(regexp_replace(s, '\\b[0-9]{{8,}}\\b', ' ', 'g'), '#\\s*[0-9]+', ' ', 'g') ELSE s END AS s FROM c2),
c4 AS (SELECT id, field, strip_accents(regexp_replace(s, '<\\s*null\\s*>|\\bnull\\b', ' ', 'g')) AS s FROM c3),
c5 AS (SELECT id, field, regexp_replace(regexp_replace(s, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS s FROM c4),
c6 AS (SELECT id, field, list_transform(list_filter(regexp_split_to_array(s, '[^0-9a-z]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_full_match(t, '0+') THEN '0' WHEN regexp_full_match(t, '[0-9]+') THEN ltrim(t, '0') ELSE t END) AS toks FROM c5),
c7 AS (SELECT id, field, string_split(trim(array_to_string(list_transform(toks, lambda t, i: t || CASE WHEN i < len(toks) AND regexp_full_match(t, '[a-z]') AND regexp_full_match(toks[i + 1], '[a-z]') THEN '' ELSE ' ' END), '')), ' ') AS toks FROM c6),
c8 AS (SELECT id, field, list_filter(toks, lambda t, i: t <> '' AND (i = 1 OR t <> toks[i - 1])) AS toks FROM c7),
c9 AS (SELECT id, field, {final} AS s FROM c8),
norm AS (SELECT b.id, b.country, b.name, b.addr, n.s AS nname, a.s AS naddr FROM base b JOIN c9 n ON n.id = b.id AND n.field = 'name' JOIN c9 a ON a.id = b.id AND a.field = 'addr')"""


def record_ctes(level: int = 4) -> str:
    """CTEs up to ``rec``: norm with token, core, trigram and number lists."""
    generic = sql_list(maps.GENERIC_NAME)
    words = lambda s: f"list_filter(string_split({s}, ' '), lambda t: t <> '')"
    tri = lambda s: f"CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, length({s}) + 1), lambda i: substr(' ' || {s} || ' ', i, 3))) END"
    nums = "list_distinct(list_transform(regexp_extract_all(coalesce(addr, ''), '[0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '0+') THEN '0' ELSE ltrim(t, '0') END))"
    return (
        with_views("txt_s1", "txt_pool")
        + ","
        + normal_ctes(level)
        + f""",
r1 AS (SELECT *, {words('nname')} AS nw, {words('naddr')} AS aw FROM norm),
r2 AS (SELECT *, CASE WHEN len(list_filter(nw, lambda t: NOT list_contains({generic}, t))) > 0 THEN list_filter(nw, lambda t: NOT list_contains({generic}, t)) ELSE nw END AS cw FROM r1),
rec AS (SELECT id, country, name, addr, nname, naddr, array_to_string(cw, ' ') AS core, cw, nw, aw, list_distinct(nw) AS ntok, list_distinct(aw) AS atok, list_distinct(cw) AS ctok,
  list_distinct(list_transform(cw, lambda t: {skeleton('t')})) AS skels, {tri('nname')} AS ntri, {tri('naddr')} AS atri, {nums} AS nums,
  CASE WHEN regexp_extract(coalesce(addr, ''), '[0-9]+') = '' THEN '' WHEN regexp_full_match(regexp_extract(coalesce(addr, ''), '[0-9]+'), '0+') THEN '0' ELSE ltrim(regexp_extract(coalesce(addr, ''), '[0-9]+'), '0') END AS num1 FROM r2)"""
    )


def jaccard(a: str, b: str, empty: str = "0") -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN {empty} ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) END"
