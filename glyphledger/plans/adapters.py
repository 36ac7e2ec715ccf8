"""Form-shaped rows from the driver's tables, in SQL that Spark and DuckDB read alike.

All noise is a function of integer keys, and so is which rows lack a label, a page or a register entry: outer and anti
joins need such rows. Every adapter reads its whole table. `{table}` stands for a table or view, in Spark for a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: An id of ten digits from an order's key: two of the year, month (+50 for every other one), day, three of a serial, check digit.
_ID = """
SELECT k, nine, (11 - (CAST(nine AS BIGINT) * 10) % 11) % 11 AS c
FROM (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || lpad(CAST(1 + o_orderkey % 12 + 50 * (o_orderkey % 2) AS STRING), 2, '0')
             || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS nine
      FROM {orders}) AS a
"""
#: The same as text: mostly well-formed, some short, some with a wrong check digit, some blank.
_ID_TEXT = f"""
SELECT k, nine, c, ten, CASE WHEN k % 23 = 0 THEN '' WHEN k % 17 = 0 THEN nine WHEN k % 3 = 0 THEN substr(ten, 1, 6) || '/' || substr(ten, 7)
       WHEN k % 3 = 1 THEN substr(ten, 1, 4) || ' ' || substr(ten, 5) || 'o' ELSE ten END AS raw
FROM (SELECT k, nine, c, nine || CAST(CASE WHEN k % 13 = 0 THEN (c + 1) % 10 WHEN c = 10 THEN 0 ELSE c END AS STRING) AS ten FROM ({_ID}) AS b) AS d
"""
#: Ids with their slash and a birth date: mostly the id's own, some impossible, short or another one.
_DATES = f"""
SELECT k, ten, substr(ten, 1, 6) || '/' || substr(ten, 7) AS person_id,
       CASE WHEN k % 11 = 0 THEN '31022001' WHEN k % 19 = 0 THEN '0101' WHEN k % 29 = 0 THEN '01010000' WHEN k % 7 = 0 THEN '15061988'
            ELSE substr(ten, 5, 2) || '.' || lpad(CAST(CAST(substr(ten, 3, 2) AS INT) % 50 AS STRING), 2, '0') || '.19' || substr(ten, 1, 2) END AS birth_date
FROM ({_ID_TEXT}) AS e
"""
SQL = {
    "money_text": """
SELECT l_orderkey, l_linenumber, CASE (l_orderkey * 7 + l_linenumber) % 9 WHEN 1 THEN replace(m, '.', ',') WHEN 2 THEN replace(m, '.', ':') WHEN 3 THEN replace(m, '.', '')
       WHEN 4 THEN replace(m, '.', '?.') WHEN 5 THEN substr(m, 1, 2) || ' ' || substr(m, 3) WHEN 6 THEN m || ' 7.5' WHEN 7 THEN '' WHEN 8 THEN substr(m, 1, 2) || '?' || substr(m, 3) ELSE m END AS raw
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS m FROM {lineitem}) AS t
""",
    "id_text": _ID_TEXT,
    "dates_text": _DATES,
    "noisy_name": """
SELECT p_partkey, p_name, CASE p_partkey % 7 WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) WHEN 2 THEN replace(p_name, 'e', 'é') WHEN 3 THEN replace(p_name, 'a', 'o')
       WHEN 4 THEN substr(p_name, 1, 3) || ' ' || substr(p_name, 4) WHEN 5 THEN upper(replace(p_name, 'o', 'ô')) WHEN 6 THEN 'q' || substr(p_name, 4) || 'zz' ELSE p_name END AS noisy
FROM {part}
""",
    "register": "SELECT 'parts' AS list_name, p_name AS entry, CAST(row_number() OVER (ORDER BY p_name) AS INT) AS ord FROM (SELECT DISTINCT p_name FROM {part} WHERE p_partkey % 3 > 0) AS t",
    # a register of made-up account names, one for each line item and each order, and customers' names read badly
    "accounts": """
SELECT 'accounts' AS list_name, entry, CAST(min(n) AS INT) AS ord
FROM (SELECT 'Account#' || lpad(CAST((l_orderkey * 7919 + l_linenumber * 104729) % 999983 AS STRING), 9, '0') AS entry, l_orderkey * 8 + l_linenumber AS n FROM {lineitem}
      UNION ALL SELECT 'Customer#' || lpad(CAST((o_orderkey * 48271) % 999979 AS STRING), 9, '0') AS entry, o_orderkey * 8 AS n FROM {orders}) AS t
GROUP BY entry
""",
    "noisy_customer": """
SELECT c_custkey, CASE c_custkey % 9 WHEN 1 THEN replace(name, 'o', '0') WHEN 2 THEN substr(name, 1, 12) || substr(name, 14) WHEN 3 THEN 'x' || name WHEN 4 THEN upper(name) || '7' WHEN 5 THEN substr(name, 1, 10) || 'l' || substr(name, 12)
       WHEN 6 THEN replace(name, 'Customer', 'Acc0unt') WHEN 7 THEN substr(name, 3) WHEN 8 THEN CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'somebody else ' || c_mktsegment END ELSE name END AS noisy
FROM (SELECT c_custkey, c_mktsegment, 'Customer#' || lpad(CAST((c_custkey * 48271 * 7) % 999979 AS STRING), 9, '0') AS name FROM {customer}) AS t
""",
    "triples": """
SELECT l_orderkey, l_linenumber, CASE WHEN k % 31 = 0 THEN '' ELSE CAST(gross AS STRING) END AS row_01, CASE WHEN k % 37 = 0 THEN '1?2.00' ELSE CAST(off AS STRING) END AS row_02,
       CAST(CASE WHEN k % 10 = 0 THEN gross - off + CAST('0.01' AS DECIMAL(18,2)) ELSE gross - off END AS STRING) AS row_03
FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(l_quantity AS DECIMAL(18,2)) AS off FROM {lineitem}) AS t
""",
    "employer": """
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN lpad(CAST(c_custkey AS STRING), 9, '2') ELSE lpad(CAST(c_custkey AS STRING), 10, '2') END AS employer_tax_id,
       CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN '8410' WHEN c_custkey % 4 = 0 THEN '841 04' ELSE lpad(CAST(c_custkey % 99999 AS STRING), 5, '0') END AS postal_code,
       CASE WHEN c_custkey % 7 = 0 THEN '5' WHEN c_custkey % 3 = 0 THEN CAST(1990 + c_custkey % 40 AS STRING) WHEN c_custkey % 11 = 0 THEN '' ELSE lpad(CAST(c_custkey % 100 AS STRING), 2, '0') END AS tax_year
FROM {customer}
""",
    "records": f"""
SELECT k AS form_id, CASE WHEN k % 5 = 0 THEN '' ELSE person_id END AS person_id, CASE WHEN k % 7 = 0 THEN '' WHEN k % 8 = 0 THEN '12345' WHEN k % 9 = 0 THEN '900101/1238' ELSE person_id END AS person_id_p2, birth_date,
       CASE WHEN k % 31 = 0 THEN '1?0.00' ELSE '100.00' END AS row_01, CASE WHEN k % 6 = 0 THEN '1.00' ELSE '20.00' END AS row_02, '80.00' AS row_03,
       CASE WHEN k % 9 = 0 THEN '' WHEN k % 10 = 0 THEN '123456789' ELSE '1234567890' END AS employer_tax_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 14 = 0 THEN '8410' ELSE '841 04' END AS postal_code,
       CASE WHEN k % 4 = 1 THEN NULL WHEN k % 15 = 0 THEN '1999' ELSE '24' END AS tax_year
FROM ({_DATES}) AS r
""",
    "obs": """
SELECT d.doc_id AS form_id, d.source AS field, CASE WHEN d.n_chars > 900 THEN '1' ELSE '0' END AS value, CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS confidence FROM {documents} AS d
""",
    "reads": """
SELECT doc_id, w, lang, CASE WHEN doc_id % 41 = 0 THEN '' WHEN w = 0 THEN text WHEN w = 1 THEN replace(text, 'a', 'o') ELSE replace(text, 'e', 'c') END AS text, CAST((doc_id * 13 + w * 29) % 50 AS DOUBLE) / 50 AS score
FROM {documents} CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1 AS w UNION ALL SELECT 2 AS w) AS widths
""",
    "answers": """
SELECT p_partkey, noisy AS reading, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 8 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN 'x7' ELSE p_name END AS response, p_partkey % 2 = 0 AS is_name,
       CAST((p_partkey * 17) % 100 AS DOUBLE) / 100 AS ratio, CAST((p_partkey * 29) % 100 AS DOUBLE) / 100 AS confidence
FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE upper(p_name) END AS noisy FROM {part}) AS t
""",
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    tables = [t for t in ("lineitem", "orders", "part", "customer", "documents") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def adapter_sql(name: str) -> str:
    sql = SQL[name]
    for t in ("lineitem", "orders", "part", "customer", "documents"):
        sql = sql.replace("{" + t + "}", t)
    return f"({sql.strip()})"
