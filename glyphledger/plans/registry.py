"""Queries over the driver's tables, by name: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphledger.functions import catalog, evidence, text, vision
from glyphledger.operators import align, descriptors, escalate, evaluate, generate, matching, pages, readings, register, repair, rules, tiers
from glyphledger.plans.adapters import adapter
from glyphledger.sources import files, sample_files, shared
from glyphledger.streaming import pairing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, source: str, keys: tuple[str, ...], **made):
    """A query that keeps `keys` of an adapter and adds columns made by functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return adapter(spark, sf_dir, source).select(*keys, *[make().alias(c) for c, make in made.items()])

    QUERIES[name] = run


c = F.col
_over("normalize_decimal", "money_text", ("l_orderkey", "l_linenumber", "raw"), value=lambda: text.normalize_decimal(c("raw")))
_over("digits_only", "money_text", ("l_orderkey", "l_linenumber"), digits=lambda: text.digits_only(c("raw")))
_over("normalize_id", "id_text", ("k", "raw"), value=lambda: text.normalize_id(c("raw")))
_over("reform_value", "id_text", ("k",), id_value=lambda: text.put_separator(c("ten"), F.lit("id")), short_value=lambda: text.put_separator(c("nine"), F.lit("id")), amount=lambda: text.put_separator(c("nine"), F.lit("decimal")), other=lambda: text.put_separator(c("nine"), F.lit("digits")))
_over("birth_from_id", "id_text", ("k",), born=lambda: text.birth_date_of(c("ten")))
_over("id_check_digit", "id_text", ("k", "nine"), digit=lambda: text.check_digit(c("nine")))
_over("corrupt_check_digit", "id_text", ("k",), broken=lambda: text.corrupted_id(c("ten"), (1 + c("k") % 9).cast("int")))
_over("fold_diacritics", "noisy_name", ("p_partkey",), folded=lambda: text.fold(c("noisy")))
_over("norm_key", "noisy_name", ("p_partkey",), lower_key=lambda: text.key_lower(c("noisy")), upper_key=lambda: text.key_upper(c("noisy")))
_over("edit_distance", "noisy_name", ("p_partkey",), d=lambda: F.levenshtein(text.key_lower(c("noisy")), text.key_lower(c("p_name"))))
_over("edit_le1", "noisy_name", ("p_partkey",), near=lambda: text.within_one_edit(text.key_lower(c("noisy")), text.key_lower(c("p_name"))))
_over("fuzzy_contains", "noisy_name", ("p_partkey",), inside=lambda: text.contains_within_one_edit(F.substring(c("p_name"), 2, 5), text.key_lower(c("noisy"))))
_over("fuzzy_text_match", "noisy_name", ("p_partkey",), agrees=lambda: text.text_agrees(c("p_name"), c("noisy")))
_over("rule_page_match", "records", ("form_id",), differs=lambda: rules.pages_differ())
_over("name_score", "reads", ("doc_id", "w"), score=lambda: readings.name_score(c("score"), 0.5), joined=lambda: readings.name_of(c("text"), c("lang")))


@query
def alphabet_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.keep_alphabet(c("text")).alias("kept"))


def _searched(spark, sf_dir):
    """A piece of each document with one or two of its letters changed, which may be in it all the same."""
    piece = F.substring(c("text"), 41, 9)
    once = F.concat(F.substring(piece, 1, 2), F.lit("#"), F.substring(piece, 4, 6))
    word = F.when(c("doc_id") % 3 == 0, once).when(c("doc_id") % 3 == 1, F.concat(F.substring(once, 1, 6), F.lit("+"), F.substring(once, 7, 3))).otherwise(F.concat(F.substring(piece, 1, 4), F.substring(piece, 6, 4)))
    return _table(spark, sf_dir, "documents").select("doc_id", "text", word.alias("word"))


@query
def fuzzy_in_documents(spark, sf_dir):
    """Whole documents searched for a word within one edit."""
    return _searched(spark, sf_dir).select("doc_id", text.contains_within_one_edit(c("word"), c("text")).alias("inside"))


@query
def fold_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(c("text")), 256).alias("folded"))


@query
def truncate_money(spark, sf_dir):
    amount = c("l_extendedprice").cast("decimal(18,2)") * F.lit("0.134").cast("decimal(4,3)")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.truncate_money(amount).alias("share"))


@query
def derived_rows(spark, sf_dir):
    """Income rows from two amounts: their sum, a truncated share, the rest, and a truncated tax on it."""
    money = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice").cast("decimal(18,2)") + c("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)").alias("row_01"))
    money = money.withColumn("row_02a", text.truncate_money(c("row_01") * F.lit("0.134").cast("decimal(4,3)")))
    money = money.withColumn("row_03", (c("row_01") - c("row_02a")).cast("decimal(18,2)"))
    return money.withColumn("row_04", text.truncate_money(c("row_03") * F.lit("0.19").cast("decimal(3,2)"))).select("l_orderkey", "l_linenumber", *[c(x).cast("string").alias(x) for x in ("row_01", "row_02a", "row_03", "row_04")])


@query
def round_half_even(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.bround(c("n_chars") / 16.0, 3).alias("rounded"))


def _pixels(spark, sf_dir):
    value = lambda x: F.floor(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", value).alias("px"))


@query
def occupancy(spark, sf_dir):
    share = evidence.dark_share(c("px"), evidence.MARK_PIXEL)
    return _pixels(spark, sf_dir).select("vec_id", share.alias("dark_frac"), evidence.occupied(c("px")).alias("occupied"), evidence.occupancy_confidence(share).alias("confidence"))


@query
def ink_gate(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", evidence.dark_share(c("px"), evidence.INK_PIXEL).alias("ink"), evidence.inked(c("px")).alias("inked"))


@query
def ink_fraction_long(spark, sf_dir):
    """The ink share as an aggregate over one row for each pixel."""
    return _pixels(spark, sf_dir).select("vec_id", F.explode("px").alias("p")).groupBy("vec_id").agg(F.avg((c("p") < evidence.INK_PIXEL).cast("int")).alias("ink"))


@query
def darken_blend(spark, sf_dir):
    both = _pixels(spark, sf_dir).select("vec_id", evidence.darken(c("px"), F.reverse("px")).alias("px"))
    return both.select("vec_id", F.aggregate("px", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.array_join(F.slice("px", 1, 8), ",").alias("head"))


@query
def crop_slice(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", F.array_join(evidence.crop(c("px"), 8, 2, 1, 5, 4), ",").alias("part"))


def _cells(spark, sf_dir):
    """Ten cells of each id: the digit, its score, what a recogniser said, and its ink."""
    k = c("k")
    place = lambda i: F.substring(c("ten"), i + 1, F.lit(1))
    score = lambda i: ((k * 31 + i * 17) % 40).cast("double") / 40
    cell = lambda i: F.struct(F.when((k + i) % 53 == 0, "?").otherwise(place(i)).alias("ch"), F.when(score(i) < 0.1, score(i)).otherwise(F.greatest(score(i), F.lit(0.9))).alias("score"), F.concat(F.lit("l"), F.when((k + i) % 53 == 0, "").otherwise(place(i))).alias("text"), (((k + i) % 21).cast("double") / 100).alias("ink"))
    return adapter(spark, sf_dir, "id_text").select("k", "ten", F.transform(F.sequence(F.lit(0), F.lit(9)), cell).alias("cells"))


@query
def field_confidence(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", evidence.field_confidence(c("cells")).alias("confidence"))


@query
def low_conf_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", F.array_join(evidence.low_cells(c("cells")), ",").alias("low"))


@query
def assemble_amount(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", evidence.amount_of(c("cells")).alias("value"))


@query
def assemble_id(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", evidence.id_of(c("cells")).alias("value"))


@query
def assemble_comb(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", evidence.digits_of(c("cells")).alias("value"))


@query
def repair_id(spark, sf_dir):
    return _cells(spark, sf_dir).select("k", repair.repaired_id(c("cells")).alias("repaired"))


@query
def geometry_grid(spark, sf_dir):
    n = (3 + c("n_nationkey") % 5).cast("int")
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", evidence.cell_row(c("n_nationkey") * 10, c("n_regionkey") * 40, 27, 24, 36, n).alias("cells"))
    hull = evidence.hull(c("cells"))
    return rows.select("n_nationkey", hull["x1"].alias("hx1"), hull["x2"].alias("hx2"), F.posexplode("cells").alias("i", "b")).select("n_nationkey", "i", "b.x1", "b.y1", "b.x2", "b.y2", "hx1", "hx2")


@query
def aspect_warning(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", evidence.aspect_off((c("p_size") + 60).cast("double"), (100 + c("p_partkey") % 9).cast("double")).alias("off"))


@query
def month_grid(spark, sf_dir):
    k = c("c_custkey")
    mode = F.when(k % 4 == 0, "all").when(k % 4 == 1, "none").otherwise("part")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(evidence.months(mode, 1 + k % 12, 1 + k % 5)).alias("i", "marked"))
    return rows.select("c_custkey", (c("i") + 1).alias("month"), "marked")


@query
def filled_children(spark, sf_dir):
    """Rows 1 to 4 of each customer, filled up to its count."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("child"))
    return rows.select("c_custkey", "child", generate.filled(c("c_custkey") % 5, c("child"), F.concat(F.lit("child "), c("child").cast("string"))).alias("name"))


def _readings(spark, sf_dir):
    """All kinds of readings in one table (form_id, field, kind, value, occupied)."""
    money = adapter(spark, sf_dir, "money_text").select(c("l_orderkey").alias("form_id"), F.concat(F.lit("row_0"), c("l_linenumber").cast("string")).alias("field"), F.lit("decimal").alias("kind"), c("raw").alias("value"))
    ids = adapter(spark, sf_dir, "id_text").select(c("k").alias("form_id"), F.lit("person_id").alias("field"), F.lit("id").alias("kind"), c("raw").alias("value"))
    dates = adapter(spark, sf_dir, "dates_text").select(c("k").alias("form_id"), F.lit("birth_date").alias("field"), F.lit("digits").alias("kind"), c("birth_date").alias("value"))
    names = adapter(spark, sf_dir, "noisy_name").select(c("p_partkey").alias("form_id"), F.lit("street").alias("field"), F.lit("text").alias("kind"), F.concat(F.lit(" "), "noisy").alias("value"))
    return money.unionByName(ids).unionByName(dates).unionByName(names)


@query
def extracted_values(spark, sf_dir):
    return _readings(spark, sf_dir).select("form_id", "field", text.extracted_value(c("kind"), c("value")).alias("value"))


@query
def field_match(spark, sf_dir):
    """Readings of all kinds against a label made of the same key."""
    marks = _table(spark, sf_dir, "customer").select(c("c_custkey").alias("form_id"), F.lit("is_correction").alias("field"), F.lit("occupancy").alias("kind"), F.when(c("c_custkey") % 3 == 0, "True").otherwise("false").alias("value"))
    truth = F.when(c("kind") == "occupancy", c("value")).when(c("kind") == "id", text.normalize_id(c("value"))).when((c("kind") == "text") & (c("form_id") % 4 == 0), F.concat(F.lit("quite else"), "value")).when(c("form_id") % 4 == 0, F.concat("value", F.lit("1"))).otherwise(c("value"))
    rows = _readings(spark, sf_dir).unionByName(marks)
    return rows.select("form_id", "field", text.value_agrees(c("kind"), truth, c("value"), c("form_id") % 2 == 0).alias("match"))


@query
def field_catalog(spark, sf_dir):
    return catalog.field_catalog(spark).groupBy("page", "kind", "class").agg(F.count("*").alias("n"), F.min("threshold").alias("threshold"))


@query
def blank_labels(spark, sf_dir):
    return catalog.blank_labels(spark).agg(F.count("*").alias("n"), F.countDistinct("field").alias("fields"), F.count_if(c("truth") == "").alias("blank"))


@query
def rule_arithmetic(spark, sf_dir):
    """Records whose amounts don't add up, and the fields that this puts in doubt."""
    rows = adapter(spark, sf_dir, "triples").where(rules.arithmetic_broken())
    return rows.select("l_orderkey", "l_linenumber", F.explode(F.array(*map(F.lit, ("row_01", "row_02", "row_03")))).alias("field"))


@query
def rule_unparsable(spark, sf_dir):
    return adapter(spark, sf_dir, "triples").where(rules.arithmetic_unparsable()).select("l_orderkey", "l_linenumber", "row_01", "row_02")


def _persons(spark, sf_dir):
    second = F.when(c("k") % 4 == 0, "").when(c("k") % 4 == 1, None).otherwise(text.normalize_id(c("raw")))
    return adapter(spark, sf_dir, "id_text").select("k", text.normalize_id(c("raw")).alias("person_id"), second.alias("person_id_p2"))


@query
def rule_id_format(spark, sf_dir):
    return _persons(spark, sf_dir).select("k", rules.id_malformed("person_id").alias("required_bad"), rules.id_malformed("person_id_p2").alias("optional_bad"))


@query
def rule_id_mod11(spark, sf_dir):
    return _persons(spark, sf_dir).select("k", rules.id_fails_mod11("person_id").alias("fails"))


@query
def rule_tax_id(spark, sf_dir):
    return adapter(spark, sf_dir, "employer").select("c_custkey", rules.tax_id_wrong().alias("wrong"))


@query
def rule_postal(spark, sf_dir):
    return adapter(spark, sf_dir, "employer").select("c_custkey", rules.postal_code_wrong().alias("wrong"))


@query
def rule_year(spark, sf_dir):
    return adapter(spark, sf_dir, "employer").select("c_custkey", rules.year_wrong().alias("wrong"))


@query
def rule_birth_cross(spark, sf_dir):
    return adapter(spark, sf_dir, "dates_text").select("k", rules.birth_date_differs().alias("differs"))


@query
def rule_calendar(spark, sf_dir):
    return adapter(spark, sf_dir, "dates_text").select("k", rules.birth_date_impossible().alias("impossible"))


def _records(spark, sf_dir):
    """Records in which every rule has something to find."""
    return adapter(spark, sf_dir, "records")


@query
def all_issues(spark, sf_dir):
    return rules.issues(_records(spark, sf_dir)).select("form_id", "rule", "rule_ord", F.array_join("fields", ",").alias("fields"))


@query
def issue_fields(spark, sf_dir):
    found = rules.issues(_records(spark, sf_dir)).select(F.explode("fields").alias("field"), "rule")
    return found.groupBy("field", "rule").agg(F.count("*").alias("n"))


@query
def widen_records(spark, sf_dir):
    years = _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("form_id"), F.lit("tax_year").alias("field"), F.lit("24").alias("value"))
    wide = rules.widen(_readings(spark, sf_dir).where("kind IN ('id', 'digits')").select("form_id", "field", "value").unionByName(years))
    return wide.select("form_id", "person_id", "birth_date", c("tax_year").isNull().alias("no_year"))


def _snap(spark, sf_dir):
    names = adapter(spark, sf_dir, "noisy_name").select("p_partkey", "noisy", F.lit("parts").alias("list_name"))
    return names, adapter(spark, sf_dir, "register")


@query
def register_snap(spark, sf_dir):
    names, entries = _snap(spark, sf_dir)
    return register.nearest_entry(names, entries, key="p_partkey", value="noisy").select("p_partkey", "gaz_value", "gaz_matched", "gaz_score")


@query
def register_index(spark, sf_dir):
    """Badly read customer names against a large register of names that are all alike."""
    names = adapter(spark, sf_dir, "noisy_customer").withColumn("list_name", F.lit("accounts"))
    return register.nearest_entry(names, adapter(spark, sf_dir, "accounts"), key="c_custkey", value="noisy").select("c_custkey", "gaz_value", "gaz_matched", "gaz_score")


@query
def register_apply(spark, sf_dir):
    names, entries = _snap(spark, sf_dir)
    rows = register.nearest_entry(names, entries, key="p_partkey", value="noisy")
    value, sure = register.apply_match(c("noisy"), (c("p_partkey") % 100).cast("double") / 100, c("gaz_value"), c("gaz_matched"))
    return rows.select("p_partkey", value.alias("value"), sure.alias("confidence"))


@query
def register_miss_pool(spark, sf_dir):
    names, entries = _snap(spark, sf_dir)
    return register.misses(names, entries, key="p_partkey", value="noisy").select("noisy").distinct()


def _escalation(spark, sf_dir):
    # line items repeat their numbers; a form has one reading of each field
    rows = _readings(spark, sf_dir).groupBy("form_id", "field", "kind").agg(F.min("value").alias("value"))
    cat = catalog.field_catalog(spark)
    # grouped once, for the confidences and for both uses of the values
    rows = shared.written(rows.select("form_id", "field", (((c("form_id") * 7 + F.length("field")) % 100).cast("double") / 100).alias("confidence"), text.extracted_value(c("kind"), c("value")).alias("value")))
    observed, extracted = rows.select("form_id", "field", "confidence"), rows.select("form_id", "field", "value")
    return escalate.reasons(observed, extracted, rules.issues(_records(spark, sf_dir)), cat)


@query
def escalate_reasons(spark, sf_dir):
    return escalate.flags(_escalation(spark, sf_dir)).select("form_id", "field", F.array_join("reasons", "; ").alias("reasons"))


@query
def escalate_flags(spark, sf_dir):
    return _escalation(spark, sf_dir).groupBy("field").agg(F.countDistinct("form_id").alias("forms"), F.count("*").alias("reasons"))


@query
def unreadable_numbers(spark, sf_dir):
    """Amounts without a digit."""
    rows = adapter(spark, sf_dir, "money_text").select("l_orderkey", "l_linenumber", text.normalize_decimal(c("raw")).alias("value"))
    return rows.where(~c("value").rlike("[0-9]"))


@query
def merge_pages(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    p1 = orders.select(c("o_orderkey").alias("form_id"), F.lit("total").alias("field"), c("o_orderpriority").alias("value"))
    p2 = orders.where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("form_id"), F.when(c("o_orderkey") % 2 == 0, "total").otherwise("state").alias("field"), c("o_orderstatus").alias("value"))
    return files.merge_pages(p1, p2)


@query
def live_merge(spark, sf_dir):
    """Orders and line items as pages in a stream that stops and goes on from its checkpoint; each form as it went out last.

    Each line item is the second page anew; pages arrive in order of their kind and number. The first run leaves forms with
    one page waiting; a later time mark, in a folder of its own, lets them go in the second run.
    """
    base = spark.createDataFrame([], pairing.PAGE)
    marks = shared.folder(spark)
    written = lambda df, mode: df.coalesce(1).write.mode(mode).parquet(marks)
    written(base, "overwrite")
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    stream = lambda name: spark.readStream.schema(_table(spark, sf_dir, name).schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    first = stream("orders").where("o_orderkey % 7 > 0").select(c("o_orderkey").cast("string").alias("form_id"), F.lit(1).alias("page"), at(F.lit(0)).alias("arrived"), F.create_map(F.lit("total"), c("o_orderpriority"), F.lit("state"), c("o_orderstatus")).alias("fields"))
    second = stream("lineitem").where("l_orderkey % 3 > 0").select(c("l_orderkey").cast("string").alias("form_id"), F.lit(2).alias("page"), at(c("l_linenumber")).alias("arrived"), F.create_map(F.lit("state"), c("l_linestatus"), F.lit("returned"), c("l_returnflag")).alias("fields"))
    out, state = shared.folder(spark), shared.folder(spark)
    for mark in (None, 86_400):
        if mark:
            written(spark.range(1).select(F.lit(None).cast("string").alias("form_id"), F.lit(None).cast("int").alias("page"), at(F.lit(mark)).alias("arrived"), F.lit(None).cast("map<string,string>").alias("fields")), "append")
        pages = first.unionByName(second).unionByName(spark.readStream.schema(pairing.PAGE).parquet(marks))
        pairing.start(pairing.live_forms(pages), out, state).awaitTermination()
    forms = pairing.latest(spark, out)
    return forms.select(c("form_id").cast("long").alias("form_id"), "status", F.explode("fields").alias("field", "value"))


@query
def pair_files(spark, sf_dir):
    """Orders as first pages; line items make a label (required) and a second page (optional)."""
    first = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = _table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    labels = lines.where("l_linenumber = 1 AND l_orderkey % 4 > 0").select(c("l_orderkey").alias("o_orderkey"), c("l_returnflag").alias("label")).groupBy("o_orderkey").agg(F.min("label").alias("label"))
    second = lines.where("l_linenumber = 2").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("p2"))
    return files.pair_pages(first, second, labels, "o_orderkey")


def _matches(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(c("doc_id").alias("form_id"), c("quality").cast("string").alias("truth"))
    rows = adapter(spark, sf_dir, "obs").join(labels, "form_id")
    return rows.select("form_id", "field", (c("value") == c("truth")).alias("correct"), "confidence", (c("confidence") < 0.7).alias("flagged"))


@query
def labels_join(spark, sf_dir):
    return _matches(spark, sf_dir)


@query
def unknown_labels(spark, sf_dir):
    sheet = adapter(spark, sf_dir, "obs").select("form_id", "field")
    known = sheet.groupBy("field").agg(F.min("form_id").alias("first")).where("first % 2 = 0").select("field")
    return evaluate.unknown_labels(sheet, known).groupBy("field").agg(F.count("*").alias("n")).orderBy("field").limit(8)


@query
def accuracy_by_field(spark, sf_dir):
    known = adapter(spark, sf_dir, "obs").select("field").distinct().unionByName(spark.sql("SELECT 'never seen' AS field"))
    return evaluate.accuracy(_matches(spark, sf_dir), known)


@query
def accuracy_overall(spark, sf_dir):
    return evaluate.overall(_matches(spark, sf_dir))


@query
def eval_report(spark, sf_dir):
    report = evaluate.worst_first(evaluate.by_field(_matches(spark, sf_dir)))
    return report.select("field", "total", "correct", "flagged", F.round("mean_conf", 9).alias("mean_conf"), F.round("acc", 9).alias("acc"), "mark")


@query
def caught_totals(spark, sf_dir):
    return evaluate.caught(evaluate.by_field(_matches(spark, sf_dir)))


@query
def best_width(spark, sf_dir):
    """The reading of the surest width, the first one at a tie; any empty strip makes the field empty and sure."""
    return readings.best_width(adapter(spark, sf_dir, "reads"), "doc_id")


def _bits(spark, sf_dir):
    """Sign bits of vectors as descriptors; 64 of them make an image, however many there are."""
    bits = F.aggregate(F.slice("embedding", 1, 62), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    return _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("image"), c("vec_id").alias("id"), bits.alias("bits"))


@query
def knn_ratio(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    return matching.good_matches(matching.two_nearest(rows, rows), 0.9)


@query
def match_guard(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    return matching.enough(matching.good_matches(matching.two_nearest(rows, rows), 0.97), 3)


def _words(vector, flipped=()):
    """Four words of bits of 64 numbers each, by four levels; in the first, the bits of some places are turned."""
    word = lambda t: F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > t, 1).otherwise(0).cast("long")))
    first, *rest = map(word, (-0.1, -0.03, 0.03, 0.1))
    for place in flipped:
        first = first.bitwiseXOR(F.expr(f"shiftleft(1L, CAST(63 - ({place}) AS INT))"))
    return F.array(first, *rest)


@query
def descriptor_knn(spark, sf_dir):
    """The two nearest of every vector among all others, by 256 bits."""
    rows = _table(spark, sf_dir, "embeddings").select(F.lit(0).alias("image"), c("vec_id").alias("id"), _words(c("embedding")).alias("bits"))
    return descriptors.two_nearest(rows, rows).select("q_id", "s_id", c("d").cast("long").alias("d"), "rank")


def _features(spark, sf_dir):
    """Features of templates, 64 to an image, and of photos of them: good ones, ambiguous ones, misplaced ones, hardly any."""
    k, m = c("vec_id"), F.expr("vec_id div 64")
    x, y = (k * 37 % 101).cast("double"), (k * 53 % 89).cast("double")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", m.alias("image"), "embedding", x.alias("u"), y.alias("v"))
    template = rows.select("image", c("vec_id").alias("id"), c("u").alias("x"), c("v").alias("y"), _words(c("embedding")).alias("bits"))
    odd = c("image") % 4 == 2
    at_x = F.when(odd, (k * k * 7919 % 997).cast("double")).otherwise(c("u") * 1.1 + 3 + F.when(k % 5 == 0, 40.0).otherwise(0.0))
    at_y = F.when(odd, (k * k * 104729 % 991).cast("double")).otherwise(c("v") * 0.9 - 2)
    photo = rows.where("image % 4 <> 3 OR vec_id % 64 < 8").select("image", c("vec_id").alias("id"), at_x.alias("x"), at_y.alias("y"), _words(c("embedding"), ("vec_id % 64", "(vec_id + 21) % 64", "(vec_id + 42) % 64")).alias("bits"))
    twice = photo.where("image % 4 = 1 AND id % 3 > 0").withColumn("id", c("id") + 1_000_000_000)
    return template, photo.unionByName(twice)


@query
def align_status(spark, sf_dir):
    """How photos align with their templates, and the pairs that agree with the map."""
    fits = align.fit(*_features(spark, sf_dir))
    return fits.select("image", "status", "matches", F.when(c("status") == "aligned", c("inliers")).alias("inliers"), F.round(F.get("h", 0), 6).alias("scale_x"), F.round(F.get("h", 5), 4).alias("shift_y"))


@query
def aligned_pages(spark, sf_dir):
    """Every small image as a page: aligned where the features of its number are, else resized with the reason."""
    small = _images(spark, sf_dir).select((c("page_id") % 16).alias("of"), "page_id", "w", "h", "pixels")
    made = align.align_pages(small.groupBy(c("of").alias("page_id")).agg(F.min("w").alias("w"), F.min("h").alias("h"), F.min_by("pixels", "page_id").alias("pixels")), *_features(spark, sf_dir), width=12, height=10)
    return made.select("page_id", "w", "h", F.length("pixels").cast("long").alias("n"), "status", "reason")


@query
def round_robin(spark, sf_dir):
    """Row i in key order goes to pool place i mod 3; the keys have gaps."""
    rows = _table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 2").select("o_orderkey")
    return readings.round_robin(rows, "o_orderkey", ("a", "b", "c"), "style")


@query
def count_broken(spark, sf_dir):
    return adapter(spark, sf_dir, "triples").agg(F.count_if(rules.arithmetic_broken()).alias("broken"), F.count_if(~rules.arithmetic_broken()).alias("fine"))


@query
def distinct_pool(spark, sf_dir):
    return register.pool(_table(spark, sf_dir, "part"), "p_name", 1, 9)


@query
def positions(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "ch"))
    return rows.where("ch <> ''")


@query
def aligned_cells(spark, sf_dir):
    """Where a text starts in a comb of 14 cells, right-aligned and in the middle."""
    n = F.length("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", evidence.aligned_start(14, n).alias("right_start"), evidence.aligned_start(14, n, middle=True).alias("middle_start"), F.lpad("p_name", 14, " ").alias("right_text"))


@query
def tier_decision(spark, sf_dir):
    return tiers.decide(adapter(spark, sf_dir, "answers")).select("p_partkey", "source", "value", "suggestion", "confidence")


@query
def tier_unavailable(spark, sf_dir):
    return tiers.decide(adapter(spark, sf_dir, "answers"), available=False).groupBy("source").agg(F.count("*").alias("n"))


@query
def escalated_text(spark, sf_dir):
    """Readings that the text tier would be asked about."""
    return adapter(spark, sf_dir, "answers").where(readings.needs_cleaner(c("confidence"), c("reading"))).select("p_partkey", "reading")


@query
def prompt_text(spark, sf_dir):
    field = F.when(c("p_partkey") % 3 == 0, "employer_company").otherwise("street")
    return adapter(spark, sf_dir, "answers").select("p_partkey", text.prompt(field, c("reading"), c("is_name")).alias("prompt"))


@query
def parse_completion(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct(F.struct(c("response").alias("content")).alias("message"))).alias("choices")))
    return adapter(spark, sf_dir, "answers").select("p_partkey", text.completion(body).alias("answer"))


@query
def label_envelope(spark, sf_dir):
    k = c("c_custkey")
    inner = F.concat(F.lit('{"name": "'), c("c_name"), F.lit('"}'))
    sheet = F.when(k % 3 == 0, F.concat(F.lit('{"labels": '), inner, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"ground_truth": '), inner, F.lit("}"))).otherwise(inner)
    return _table(spark, sf_dir, "customer").select("c_custkey", files.envelope(sheet)["name"].alias("name"))


@query
def json_sidecar(spark, sf_dir):
    """Properties of events, with a default where one is missing."""
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"), F.get_json_object("props", "$").isNotNull().alias("parsed"))


@query
def result_json(spark, sf_dir):
    """The answer document, parsed again: numbers of fields and failed rules, and a rounded confidence."""
    records = _records(spark, sf_dir)
    fields = records.select("form_id", F.lit("person_id").alias("field"), c("person_id").alias("value"), ((c("form_id") % 1000).cast("double") / 1024).alias("confidence"))
    body = files.result_json(fields, rules.issues(records), escalate.flags(_escalation(spark, sf_dir)).where("field = 'person_id'"))
    return body.select("form_id", F.get_json_object("body", "$.fields.person_id").alias("person_id"), F.get_json_object("body", "$.confidences.person_id").cast("double").alias("confidence"), F.size(F.from_json(F.get_json_object("body", "$.issues"), "array<string>")).cast("long").alias("n_issues"))


@query
def answer_document(spark, sf_dir):
    """The whole answer of each record, parsed again: values, thresholds, repairs, suggestions, doubts, warnings before rules."""
    records = _records(spark, sf_dir)
    k, cat = c("form_id"), F.broadcast(catalog.field_catalog(spark).select("field", "threshold"))
    value = F.explode(F.create_map(F.lit("person_id"), c("person_id"), F.lit("street"), F.concat(F.lit("street "), k.cast("string")), F.lit("tax_year"), c("tax_year"))).alias("field", "value")
    rows = records.select("form_id", value).withColumns({"confidence": (k % 1000).cast("double") / 1024, "repaired": F.when((k % 5 > 0) & (c("field") == "person_id") & (k % 4 == 0), "old"), "suggestion": F.when((c("field") == "street") & (k % 3 == 0), F.upper("value")).otherwise(""), "source": F.when(c("field") == "street", "cleaner")})
    flags = records.where("form_id % 6 = 0").select("form_id", F.lit("street").alias("field"), F.array(F.lit("unsure"), F.lit("unlisted")).alias("reasons"))
    warnings = records.select("form_id", F.lit(2).alias("page"), F.when(k % 9 == 0, "page 2 is not shaped like the form").alias("warning"))
    body = files.answer_documents(rows.join(cat, "field"), rules.issues(records), flags, warnings)
    words, numbers = "map<string,string>", "map<string,double>"
    parsed = F.from_json("body", f"fields {words}, confidences {numbers}, thresholds {numbers}, disambiguated {words}, suggestions {words}, second_check {words}, validation_issues array<string>, flagged_fields array<string>, field_reasons map<string,array<string>>")
    get = lambda part, field: F.try_element_at(c(f"b.{part}"), F.lit(field))
    several = lambda texts: F.array_join(texts, "|")
    return body.select("form_id", parsed.alias("b")).select("form_id", get("fields", "person_id").alias("person_id"), get("fields", "tax_year").alias("tax_year"), get("confidences", "street").alias("sure"), get("thresholds", "street").alias("needed"), get("disambiguated", "person_id").alias("repair"), get("suggestions", "street").alias("suggestion"), get("second_check", "street").alias("source"), several("b.validation_issues").alias("issues"), several("b.flagged_fields").alias("flagged"), several(get("field_reasons", "street")).alias("reasons"))


@query
def readings_in_catalog(spark, sf_dir):
    """Readings of all kinds by what the form says of their fields, and how many are below what their class needs."""
    cat = F.broadcast(catalog.field_catalog(spark).drop("kind"))
    rows = _readings(spark, sf_dir).withColumn("confidence", ((c("form_id") * 7 + F.length("field")) % 100).cast("double") / 100).join(cat, "field")
    return rows.groupBy("field", "page", "class", "tier").agg(F.min("threshold").alias("threshold"), F.count("*").alias("n"), F.count_if(c("confidence") < c("threshold")).alias("below"))


@query
def base64_image(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", files.as_base64(c("c_name").cast("binary")).alias("b64"))


@query
def similarity_ratio(spark, sf_dir):
    return adapter(spark, sf_dir, "noisy_name").select("p_partkey", tiers.similarity(c("noisy"), c("p_name")).alias("ratio"))


@query
def revalidate_text(spark, sf_dir):
    rows = adapter(spark, sf_dir, "noisy_name").select("p_partkey", "noisy", "p_name", tiers.similarity(c("noisy"), c("p_name")).alias("ratio"))
    return rows.select("p_partkey", tiers.revalidates(c("noisy"), c("p_name"), c("ratio")).alias("ok"))


def _images(spark, sf_dir):
    small = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    pixels = F.unhex(F.array_join(F.transform(small, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    return _table(spark, sf_dir, "embeddings").select(c("vec_id").alias("page_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), pixels.alias("pixels"))


@query
def resize_canvas(spark, sf_dir):
    return vision.resize_to_canvas(_images(spark, sf_dir), 16, 12).select("page_id", "w", "h", F.length("pixels").cast("long").alias("n"))


@query
def warp_page(spark, sf_dir):
    shift = F.array(*[F.lit(float(x)) for x in (1, 0, 2, 0, 1, 1, 0, 0, 1)])
    return vision.warp_pages(_images(spark, sf_dir).withColumn("map", shift), 8, 8).select("page_id", F.sha2("pixels", 256).alias("sha"))


@query
def comb_strip(spark, sf_dir):
    cells = F.array(*[F.array(*map(F.lit, box)) for box in ((0, 0, 4, 8), (4, 0, 8, 8))])
    pages = _images(spark, sf_dir).withColumns({"field": F.lit("name"), "cells": cells})
    return vision.read_strips(pages, _mean_reader)


@query
def samples_on_disk(spark, sf_dir):
    """Every small image as a form of two pages with its document, written as files and read back from them."""
    rows = _images(spark, sf_dir).select("w", "h", "pixels", c("page_id").cast("string").alias("name"), (c("page_id") % 3 > 0).alias("two"))
    document = F.to_json(F.struct(c("name").alias("sample_id"), F.when(c("name") % 5 == 0, True).alias("_is_broken"), F.create_map(F.lit("row_01"), "name").alias("ground_truth")))
    path = shared.folder(spark)
    other = F.when(c("two"), F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("pixels"), F.lit(".."), F.lit(0))), "")))
    sample_files.write_sample_files(rows.select("name", files.as_png("w", "h", "pixels").alias("p1"), files.as_png("w", "h", other).alias("p2"), document.alias("document")), path)
    told = files.read_samples(spark, f"{path}/part-*/*.json").select(c("sample_id").alias("name"), "_is_broken", c("ground_truth")["row_01"].alias("row_01"))
    seen = files.decode_pages(spark, f"{path}/part-*").select(F.regexp_extract("name", "^(.*)_p[12]$", 1).alias("name"), F.regexp_extract("name", "_p([12])$", 1).alias("page"), F.sha2("pixels", 256).alias("sha"))
    both = seen.groupBy("name").agg(*[F.max(F.when(c("page") == p, c("sha"))).alias(f"p{p}_sha") for p in "12"])
    stems = files.read_pages(spark, f"{path}/part-*").select(c("stem").alias("name"), c("p2").isNotNull().alias("two"))
    return told.join(both, "name").join(stems, "name").select(c("name").cast("long").alias("vec_id"), "row_01", c("_is_broken").alias("broken"), "two", "p1_sha", "p2_sha")


def _mean_reader(strip):
    """Stands in for a recogniser: a strip's size and its mean tone."""
    return f"{strip.shape[1]}x{strip.shape[0]}", float(strip.mean()) / 255


@query
def homography_fit(spark, sf_dir):
    """Maps of images of 64 point pairs each, however many there are; every seventh pair is off."""
    k = c("vec_id")
    x, y = (k * 37 % 101).cast("double"), (k * 53 % 89).cast("double")
    off = F.when(k % 7 == 0, 40.0).otherwise(0.0)
    pairs = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("image"), x.alias("x"), y.alias("y"), (x * 1.1 + 3 + off).alias("u"), (y * 0.9 - 2).alias("v"))
    return vision.fit_homographies(pairs).select("image", "inliers", F.round(F.get("h", 0), 6).alias("scale_x"), F.round(F.get("h", 2), 6).alias("shift_x"))


def _generated(spark, sf_dir):
    """A form for each customer; every kind of fault in turn, and one in eight without."""
    k = c("c_custkey")
    broken = F.get(F.array(*map(F.lit, generate.FAULTS)), (k % 8 - 1).cast("int"))
    specs = _table(spark, sf_dir, "customer").select(k.alias("form_id"), (k % 2 == 0).alias("female"), (k % 5).cast("int").alias("children"), F.when(k % 3 == 0, "all").otherwise("part").alias("months"), broken.alias("broken"))
    return generate.generate(specs)


@query
def generated_faults(spark, sf_dir):
    """The rules that generated forms break, by the fault that was put in."""
    forms = _generated(spark, sf_dir)
    found = rules.issues(forms).select("form_id", "rule")
    return found.join(forms.select("form_id", "broken"), "form_id").groupBy("broken", "rule").agg(F.count("*").alias("n"))


@query
def generated_months(spark, sf_dir):
    forms = _generated(spark, sf_dir).select("form_id", F.size(F.filter("months", lambda m: m)).alias("n"))
    return forms.select("form_id", (c("n") == 12).alias("all_year"), (c("n") > 0).alias("any_month"))


@query
def cleaner_lookup(spark, sf_dir):
    """Unsure readings with the answers that a cleaner gave to the same question before."""
    rows = adapter(spark, sf_dir, "answers").withColumn("field", F.lit("street"))
    answers = rows.where("p_partkey % 3 > 0").select("field", "reading", "is_name", "response")
    return tiers.with_answers(rows.select("p_partkey", "field", "reading", "is_name", "confidence"), answers).select("p_partkey", "response")


@query
def page_observations(spark, sf_dir):
    """A mark, a box, two digits, a word and a name of every small image, each read in the way of its kind."""
    halves = (((0, 0, 4, 4), (4, 0, 8, 4)),)
    at = [pages.Layout("is_correction", "mark", (0, 0, 8, 8)), pages.Layout("p2_row_09", "box", (1, 1, 7, 7)), pages.Layout("tax_year", "cells", combs=halves), pages.Layout("street", "comb", combs=halves), pages.Layout("person_name", "names", combs=(*halves, ((0, 4, 4, 8),)))]
    found = pages.page_evidence(_images(spark, sf_dir), at, _size_reader, _mean_reader)
    seen = pages.observations(found, catalog.field_catalog(spark))
    of = lambda field, value: F.max(F.when(c("field") == field, value))
    return seen.groupBy("page_id").agg(F.count("*").alias("n"), of("is_correction", c("occupied")).alias("marked"), F.round(of("is_correction", c("confidence")), 9).alias("sure"), of("p2_row_09", c("value")).alias("box"))


def _size_reader(image):
    """Stands in for a recogniser of digits."""
    return str(image.shape[0]), 0.9
