"""Synthetic form values with injected faults, for tests and demonstrations.

Every value is a function of the form's key, so forms can be made in parallel and in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphledger.functions.evidence import months
from glyphledger.functions.text import birth_date_of, check_digit, corrupted_id, truncate_money

#: Faults by name.
FAULTS = ("arithmetic", "check digit", "birth date", "page match", "postal length", "tax id length", "year range")


def draw(key: Column, salt: str, n: int | Column) -> Column:
    """A number from 0 to n - 1 that the key and the salt decide."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), n if isinstance(n, Column) else F.lit(n))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def valid_id(key: Column, salt: str, female: Column) -> Column:
    """Ten digits divisible by 11: the first serial number from a drawn one on that has a check digit."""
    year, month, day = draw(key, salt + "y", 60) + 40, draw(key, salt + "m", 12) + 1, draw(key, salt + "d", 28) + 1
    front = F.concat(_padded(year, 2), _padded(month + F.when(female, 50).otherwise(0), 2), _padded(day, 2))
    start = draw(key, salt + "s", 900)
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(front, _padded(start + i, 3)))
    nine = F.get(F.filter(tries, lambda n: check_digit(n) < 10), 0)
    return F.concat(nine, check_digit(nine).cast("string"))


def filled(count: Column, i: Column, value: Column) -> Column:
    """The value in the first `count` rows (from 1), blank after them."""
    return F.when(i <= count, value).otherwise("")


def sample_specs(spark: SparkSession, n: int = 20) -> DataFrame:
    """n specs for generate(): every kind of fault and every way to fill the months and child rows in turn, one in eight
    without a fault; pool names where names are drawn from, and every sixth spec asks for names no register has."""
    i = F.col("form_id")
    fault = F.get(F.array(*map(F.lit, FAULTS)), (i % (len(FAULTS) + 1) - 1).cast("int"))
    months_ = F.get(F.array(*map(F.lit, ("all", "none", "master", "part"))), (i % 4).cast("int"))
    return spark.range(1, n + 1).select(F.col("id").alias("form_id")).select("form_id", (i % 2 == 0).alias("female"), (i % 5).cast("int").alias("children"), months_.alias("months"), fault.alias("broken"), F.when(i % 6 == 0, "unlisted").otherwise("listed").alias("pool"))


def draw_names(forms: DataFrame, pools: DataFrame, to: str, *, key: str = "form_id", pool: str = "pool") -> DataFrame:
    """forms with a column drawn from the entries of their pool, pools (pool, entry); null where a pool has none.

    The same key draws the same entry. Forms meet their pool's size and then one entry, by equi-joins.
    """
    entries = pools.select(F.col("pool").alias("_pool"), F.col("entry").alias(to)).distinct()
    numbered = entries.select(F.col("_pool").alias("_of"), to, (F.row_number().over(Window.partitionBy("_pool").orderBy(to)) - 1).alias("_place"))
    sizes = entries.groupBy("_pool").agg(F.count("*").alias("_n"))
    asked = forms.join(sizes, F.col(pool) == F.col("_pool"), "left").withColumn("_at", draw(F.col(key), to, F.col("_n")).cast("int"))
    return asked.join(numbered, (F.col(pool) == F.col("_of")) & (F.col("_at") == F.col("_place")), "left").select(*forms.columns, to)


def _slashed(ten: Column) -> Column:
    return F.concat(F.left(ten, F.lit(6)), F.lit("/"), F.right(ten, F.lit(4)))


def generate(specs: DataFrame) -> DataFrame:
    """Wide forms from specs (form_id, female boolean, children int, months string, broken string or null).

    Incomes follow from two drawn amounts: row_01 their sum, row_02a a truncated 13.4 percent of the first, row_03 the
    rest, row_04 a truncated 19 percent of it. The first `children` rows of child ids are filled, the others blank. Months that
    are "master" have the mark for the whole year, and none of the twelve.
    """
    k = F.col("form_id")
    broken = lambda name: F.coalesce(F.col("broken") == name, F.lit(False))
    out = specs.withColumns({"ten": valid_id(k, "person", F.col("female")), "row_01a": ((draw(k, "a", 5_000_000) + 100_000) / 100).cast("decimal(12,2)"), "row_01b": (draw(k, "b", 100_000) / 100).cast("decimal(12,2)")})
    out = out.withColumn("row_01", (F.col("row_01a") + F.col("row_01b")).cast("decimal(12,2)"))
    out = out.withColumn("row_02", truncate_money(F.col("row_01a") * F.lit("0.134").cast("decimal(4,3)")).cast("decimal(12,2)"))
    out = out.withColumn("row_03", (F.col("row_01") - F.col("row_02")).cast("decimal(12,2)"))
    born = birth_date_of(F.col("ten"))
    shown = F.when(broken("check digit"), corrupted_id(F.col("ten"), (draw(k, "shift", 9) + 1).cast("int"))).otherwise(F.col("ten"))
    other_day = F.concat(F.when(F.left(born, F.lit(2)) == "01", "02").otherwise("01"), F.substring(born, 3, 6))
    columns = {
        "person_id": _slashed(shown),
        "person_id_p2": F.when(broken("page match"), _slashed(valid_id(k, "other", ~F.col("female")))).otherwise(_slashed(shown)),
        "birth_date": F.when(broken("birth date"), other_day).otherwise(born),
        "tax_year": F.when(broken("year range"), F.lit("5")).otherwise(_padded(draw(k, "year", 30), 2)),
        "postal_code": F.left(_padded(draw(k, "postal", 100_000), 5), F.when(broken("postal length"), 4).otherwise(5)),
        "employer_tax_id": F.left(_padded(draw(k, "tax", 9_000_000_000) + 1_000_000_000, 10), F.when(broken("tax id length"), 9).otherwise(10)),
        "row_01a": F.col("row_01a").cast("string"),
        "row_01b": F.col("row_01b").cast("string"),
        "row_01": F.col("row_01").cast("string"),
        "row_02": F.col("row_02").cast("string"),
        "row_03": F.when(broken("arithmetic"), (F.col("row_03") + 1).cast("decimal(12,2)")).otherwise(F.col("row_03")).cast("string"),
        "row_04": truncate_money(F.col("row_03") * F.lit("0.19").cast("decimal(3,2)")).cast("string"),
        **{f"child{i}_id": filled(F.col("children"), F.lit(i), _slashed(valid_id(k, f"child{i}", draw(k, f"sex{i}", 2) == 0))) for i in range(1, 5)},
        "month_all": F.col("months") == "master",
        "months": months(F.col("months"), (draw(k, "from", 12) + 1).cast("int"), (draw(k, "n", 5) + 1).cast("int")),
    }
    return out.select("form_id", "broken", *[c.alias(n) for n, c in columns.items()])
