"""Stand-in relations over the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {g} is the global flag that DuckDB's regexp_replace needs.
VIEWS = {
    "er_s1": "SELECT c_custkey AS qi, c_name AS name, c_nationkey AS country, c_custkey % 5 AS fold FROM customer",
    "er_pool": "SELECT o_orderkey AS pj, CASE WHEN o_orderkey % 2 = 0 THEN 'S2' ELSE 'S3' END AS src, CASE WHEN o_orderkey % 4 = 0 THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS owner, o_custkey AS seed FROM orders",
    "er_truth": "SELECT s.qi, s.country, s.fold, count(p.pj) AS k FROM er_s1 s LEFT JOIN er_pool p ON p.owner = s.qi GROUP BY s.qi, s.country, s.fold",
    "er_scored": (
        "SELECT qi, pj, max(p) AS p FROM (SELECT owner AS qi, pj, CASE WHEN pj % 11 = 0 THEN CAST((pj * 17) % 400 AS DOUBLE) / 1000 ELSE CAST(500 + (pj * 37) % 500 AS DOUBLE) / 1000 END AS p FROM er_pool WHERE owner >= 0 AND pj % 10 <> 0 "
        "UNION ALL SELECT (seed * 7 + pj * 13) % (SELECT count(*) FROM customer) AS qi, pj, CAST((pj * 53) % 800 AS DOUBLE) / 1000 AS p FROM er_pool "
        "UNION ALL SELECT (seed + 17) % (SELECT count(*) FROM customer) AS qi, pj, CAST((pj * 91) % 600 AS DOUBLE) / 1000 AS p FROM er_pool) u GROUP BY qi, pj"
    ),
    "er_claims": "SELECT s.qi, s.pj, s.p, p.owner, p.src, p.owner = s.qi AS tp FROM er_scored s JOIN er_pool p ON p.pj = s.pj",
    # The first line is the name, the rest of the text the address.
    "txt_all": "SELECT doc_id, lang AS country, trim(regexp_replace(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END, '[\\n\\r\\t ]+', ' '{g})) AS name, trim(regexp_replace(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END, '[\\n\\r\\t ]+', ' '{g})) AS addr, source FROM documents",
    "txt_s1": "SELECT doc_id AS qi, name, addr, country FROM txt_all WHERE doc_id % 5 = 0",
    "txt_pool": "SELECT doc_id AS pj, name, addr, country, CASE WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS src FROM txt_all WHERE doc_id % 5 <> 0",
    "txt_pairs": "SELECT s.qi, p.pj, s.country FROM txt_s1 s JOIN txt_pool p ON p.pj BETWEEN s.qi + 1 AND s.qi + 4",
    "vec_q": "SELECT vec_id AS qi, embedding AS e, label AS country FROM embeddings WHERE vec_id % 5 = 0",
    "vec_p": "SELECT vec_id AS pj, embedding AS e, label AS country, CASE WHEN vec_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS src FROM embeddings WHERE vec_id % 5 <> 0",
}
NEEDS = {
    "er_truth": ["er_s1", "er_pool"],
    "er_scored": ["er_pool"],
    "er_claims": ["er_scored", "er_pool"],
    "txt_s1": ["txt_all"],
    "txt_pool": ["txt_all"],
    "txt_pairs": ["txt_s1", "txt_pool"],
}


def order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*order(NEEDS.get(n, [])), n] if x not in out]
    return out


def with_views(*names: str) -> str:
    """The WITH list of the views, in DuckDB's words."""
    return ", ".join(f"{n} AS ({VIEWS[n].format(g=chr(44) + chr(32) + chr(39) + 'g' + chr(39))})" for n in order(list(names)))


class Views:
    """The same views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name].format(g="")
        parts = {t: self.table(t) for t in TABLES if f" {t}" in sql} | {n: getattr(self, n) for n in NEEDS.get(name, [])}
        for t, df in parts.items():
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self._spark.sql(sql, **{t: df for t, df in parts.items() if f"{{{t}}}" in sql})
