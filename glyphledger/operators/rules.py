"""Consistency rules over wide records: each rule is a condition and the fields it puts in doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.functions.text import digits_only

ID_FORM = "^[0-9]{6}/[0-9]{4}$"
#: Ids in field order, which is the order of their issues.
ID_FIELDS = ("child1_id", "child2_id", "child3_id", "child4_id", "person_id", "person_id_p2")


def _amount(c: str) -> Column:
    return F.col(c).try_cast("decimal(18,2)")


def arithmetic_broken() -> Column:
    return F.coalesce(_amount("row_01") - _amount("row_02") != _amount("row_03"), F.lit(False))


def arithmetic_unparsable() -> Column:
    return _amount("row_01").isNull() | _amount("row_02").isNull() | _amount("row_03").isNull()


def id_malformed(field: str) -> Column:
    """Blank and missing ids pass, but for the main one, which is required."""
    value = F.coalesce(F.col(field), F.lit(""))
    bad = ~value.rlike(ID_FORM)
    return bad if field == "person_id" else bad & (value != "")


def id_fails_mod11(field: str) -> Column:
    value = F.coalesce(F.col(field), F.lit(""))
    return F.when(value.rlike(ID_FORM), F.replace(value, F.lit("/"), F.lit("")).cast("long") % 11 != 0).otherwise(F.lit(False))


def pages_differ() -> Column:
    return (F.coalesce(F.col("person_id_p2"), F.lit("")) != "") & ~F.col("person_id_p2").eqNullSafe(F.col("person_id"))


def tax_id_wrong() -> Column:
    value = F.coalesce(F.col("employer_tax_id"), F.lit(""))
    return (value != "") & (F.length(digits_only(value)) != 10)


def postal_code_wrong() -> Column:
    """Only where the field is there at all; a blank one fails."""
    return F.col("postal_code").isNotNull() & (F.length(digits_only(F.col("postal_code"))) != 5)


def year_wrong() -> Column:
    digits = digits_only(F.col("tax_year"))
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.when(digits == "", F.lit(0)).otherwise(F.lit(999999)))
    year = F.when(F.length(digits) == 2, number + 2000).otherwise(number)
    return F.col("tax_year").isNotNull() & ~year.between(2000, 2099)


def _birth() -> tuple[Column, Column, Column]:
    """(both readable, a calendar date, digits of the date)"""
    digits = digits_only(F.col("birth_date"))
    gate = F.coalesce(F.col("person_id").rlike(ID_FORM) & (F.length(digits) == 8), F.lit(False))
    valid = F.try_to_date(digits, "ddMMyyyy").isNotNull() & (F.substring(digits, 5, 4) != "0000")
    return gate, F.coalesce(valid, F.lit(False)), digits


def birth_date_differs() -> Column:
    gate, valid, d = _birth()
    person = F.col("person_id")
    month = F.lpad((F.substring(person, 3, 2).try_cast("int") % 50).cast("string"), 2, "0")
    same = (F.substring(d, 7, 2) == F.substring(person, 1, 2)) & (F.substring(d, 3, 2) == month) & (F.substring(d, 1, 2) == F.substring(person, 5, 2))
    return gate & valid & ~same


def birth_date_impossible() -> Column:
    gate, valid, _ = _birth()
    return gate & ~valid


#: (rule, order, condition, fields); conditions are functions, as columns need a session.
RULES: list[tuple] = [
    ("arithmetic", 10, arithmetic_broken, ("row_01", "row_02", "row_03")),
    ("arithmetic_unparsable", 11, arithmetic_unparsable, ("row_01", "row_02", "row_03")),
    *[(f"{kind}:{f}", 20 + 2 * i + j, (lambda f=f, test=test: test(f)), (f,)) for i, f in enumerate(ID_FIELDS) for j, (kind, test) in enumerate((("id_format", id_malformed), ("id_mod11", id_fails_mod11)))],
    ("page_match", 40, pages_differ, ("person_id_p2", "person_id")),
    ("tax_id_length", 50, tax_id_wrong, ("employer_tax_id",)),
    ("postal_length", 60, postal_code_wrong, ("postal_code",)),
    ("year_range", 70, year_wrong, ("tax_year",)),
    ("birth_date_id", 80, birth_date_differs, ("birth_date", "person_id")),
    ("birth_date_calendar", 81, birth_date_impossible, ("birth_date",)),
]
RULE_FIELDS = ("row_01", "row_02", "row_03", *ID_FIELDS, "employer_tax_id", "postal_code", "tax_year", "birth_date")


def widen(extracted: DataFrame) -> DataFrame:
    """One row for each form from long (form_id, field, value); a missing field is null, a blank one ''."""
    return extracted.groupBy("form_id").agg(*[F.max(F.when(F.col("field") == f, F.coalesce("value", F.lit("")))).alias(f) for f in RULE_FIELDS])


def issues(wide: DataFrame, key: str = "form_id") -> DataFrame:
    """(key, rule, rule_ord, fields) of every rule that fires; columns that a record lacks count as missing fields.

    All rules are evaluated in one pass over the records and exploded, so nothing is shuffled.
    """
    absent = {f: F.lit(None).cast("string") for f in RULE_FIELDS if f not in wide.columns}
    found = [F.when(test(), F.struct(F.lit(name).alias("rule"), F.lit(at).alias("rule_ord"), F.array(*map(F.lit, fields)).alias("fields"))) for name, at, test, fields in RULES]
    rows = wide.withColumns(absent).select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i"))
    return rows.select(key, "i.rule", "i.rule_ord", "i.fields")
