"""The fields of a form: kind, class, tier and review threshold. A small table whose size the form fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphledger.functions.evidence import THRESHOLDS

_SCHEMA = "field string, page int, kind string, class string, tier string, threshold double, list_name string, n_int int, n_dec int"


def _rows():
    def row(field, page, kind, tier=None, register=None, n_int=0, n_dec=0):
        cls = {"occupancy": "occupancy", "text": "text"}.get(kind, "numeric")
        return field, page, kind, cls, tier, THRESHOLDS[cls], register, n_int, n_dec

    for field, page in (("person_id", 1), ("person_id_p2", 2), *((f"child{i}_id", 2) for i in range(1, 5))):
        yield row(field, page, "id", n_int=10)
    for field, page, n in (("birth_date", 1, 8), ("tax_year", 1, 2), ("postal_code", 1, 5), ("house_no", 1, 7), ("employer_tax_id", 2, 10), ("employer_house_no", 2, 8), ("employer_postal_code", 2, 5), ("issue_date", 2, 6)):
        yield row(field, page, "digits", n_int=n)
    for name in ("01", "01a", "01b", "02", "02a", "02b", "03", "04", "05"):
        yield row(f"row_{name}", 1, "decimal", n_int=8, n_dec=2)
    for name, n in (("06", 3), ("07", 4), ("08", 3), ("08a", 3), ("09", 3)):
        yield row(f"row_{name}", 1, "decimal", n_int=n, n_dec=2)
    for name, n in (("08a", 3), ("09", 3), ("10", 4), ("11", 4), ("12", 8)):
        yield row(f"p2_row_{name}", 2, "decimal", n_int=n, n_dec=2)
    for side, page in (("", 1), ("employer_", 2)):
        for name in ("title", "municipality", "country"):
            yield row(side + name, page, "text", "register", name)
        yield row(side + "street", page, "text", "semi-open")
    yield row("employer_company", 2, "text", "semi-open")
    for field, page in (("person_name", 1), ("employer_surname", 2), ("employer_given", 2), ("prepared_by", 2), *((f"child{i}_name", 2) for i in range(1, 5))):
        yield row(field, page, "text", "name")
    for field in ("is_correction", "limited_liability"):
        yield row(field, 1, "occupancy")
    for group in ("r10", "r13", "child1", "child2", "child3", "child4"):
        for month in ("all", *(f"{m:02d}" for m in range(1, 13))):
            yield row(f"{group}_month_{month}", 2, "occupancy")


def field_catalog(spark: SparkSession) -> DataFrame:
    """One row for each of the form's 130 fields."""
    return spark.createDataFrame(list(_rows()), _SCHEMA)


def blank_labels(spark: SparkSession) -> DataFrame:
    """A label sheet to fill in: every field with an empty value."""
    return field_catalog(spark).selectExpr("field", "'' AS truth")
