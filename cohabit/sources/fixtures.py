"""Study tables as views of the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = "SELECT 'SRR' || CAST(l_orderkey AS STRING) AS acc, 1 + l_partkey % 20 AS tax_id, l_discount AS total_abundance FROM lineitem"
MICROBE = """SELECT 'SRR' || CAST(l_orderkey AS STRING) AS acc, 1001 + l_suppkey % 15 AS tax_id, l_tax AS total_abundance,
  CASE WHEN l_suppkey % 15 % 3 = 0 THEN 'Bacteria' WHEN l_suppkey % 15 % 3 = 1 THEN 'Viruses' ELSE 'Fungi' END AS pathogen_type FROM lineitem"""
ABUNDANCE = "SELECT acc, tax_id, total_abundance FROM fx_host UNION ALL SELECT acc, tax_id, total_abundance FROM fx_microbe"
_PAIR = """SELECT host_tax_id, path_tax_id, pathogen_root_label, 'host_' || CAST(host_tax_id AS STRING) AS Host_Name, 'microbe_' || CAST(path_tax_id AS STRING) AS Pathogen_Name"""
META = f"""WITH p AS (SELECT h.tax_id AS host_tax_id, m.tax_id AS path_tax_id, m.pathogen_type AS pathogen_root_label
  FROM (SELECT DISTINCT tax_id FROM fx_host) h CROSS JOIN (SELECT DISTINCT tax_id, pathogen_type FROM fx_microbe) m)
{_PAIR}, CASE (host_tax_id * 7 + path_tax_id) % 5 WHEN 0 THEN 'Positive Control' WHEN 1 THEN 'Negative Control' WHEN 2 THEN 'Commensal' ELSE 'PHI-Base' END AS Interaction_type
  FROM p WHERE (host_tax_id + path_tax_id) % 4 <> 0
UNION ALL {_PAIR}, 'Negative Control' AS Interaction_type FROM p WHERE (host_tax_id + path_tax_id) % 4 <> 0 AND host_tax_id % 6 = 0"""
_LISTS = """SELECT 1 + l_partkey % 20 AS host_tax_id, 1001 + l_suppkey % 15 AS microbe_tax_id, {collect} 'SRR' || CAST(l_orderkey AS STRING)) AS SRA_datasets
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1, 2"""
SRA_META = "SELECT 'SRR' || CAST(o_orderkey AS STRING) AS acc, o_orderstatus AS platform, o_orderpriority AS center, o_orderdate AS releasedate FROM orders"

_SPARK = {"fx_host": HOST, "fx_microbe": MICROBE, "fx_abundance": ABUNDANCE, "fx_meta": META, "fx_pairs_lists": _LISTS.format(collect="collect_set("), "fx_sra_meta": SRA_META}
#: WITH clauses that put the same views in front of a DuckDB query.
DUCKDB = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (_SPARK | {"fx_pairs_lists": _LISTS.format(collect="list(DISTINCT")}).items())


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fixture views by name."""
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    out = {}
    for name, sql in _SPARK.items():
        used = {k: v for k, v in (views | out).items() if k in sql}
        for k, v in used.items():
            v.createOrReplaceTempView(k)
        out[name] = spark.sql(sql)
    return out


def population(spark: SparkSession, sf_dir: str) -> int:
    """Number of datasets of the fixtures: rows of ``orders``."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()
