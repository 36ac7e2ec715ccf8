"""Snapping readings to reference registers: the nearest entry, and whether it is near enough."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.functions.text import key_lower
from glyphledger.functions.trie import Trie, nearest
from glyphledger.sources.shared import written

#: An entry is accepted within this share of the longer key, at least one edit; hits are this sure.
TOLERANCE, SURE = 0.34, 0.85
#: A register of up to so many bytes is broadcast as a trie; a larger one is dealt into shards of about so many entries.
MAX_BROADCAST_BYTES, SHARD_ENTRIES = 32 << 20, 20_000
#: A register of more bytes is joined by a shuffle: rows sent to all executors go through the driver, at some three times their bytes.
MAX_SENT_BYTES = 4 << 20
#: Readings that meet a shard in one task; a shard that more of them visit is copied. Up to so many pairs of a reading and a
#: shard may meet before it is known whether they have to.
VISITS, FEW = 50_000, 5_000


def radius(length: np.ndarray) -> np.ndarray:
    """The farthest an entry can be from a key of this length and still be accepted: it is longer by its distance at most."""
    reach = np.ones(len(length), np.int64)
    while (more := reach + 1 <= np.floor((length + reach + 1) * TOLERANCE)).any():
        reach += more
    return reach


def _reach(length: pd.Series) -> pd.Series:
    return pd.Series(radius(length.to_numpy(np.int64)))


def _texts(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts as plain objects, whatever pandas makes of them."""
    return rows.astype({name: object for name in ("_list", "_key", "entry") if name in rows})


class _Lists:
    """A trie for each list of entries (_list, _key, ...) with distinct keys; the least by the columns `order` wins a tie."""

    def __init__(self, entries: pd.DataFrame, order: list[str]) -> None:
        self.of, self.order = {}, order
        for name, rows in entries.groupby("_list", dropna=False):
            rows = rows.sort_values(order, na_position="last").reset_index(drop=True)
            self.of[name] = Trie(rows["_key"].tolist()), rows

    def nearest(self, asked: pd.DataFrame, least: int = 1) -> Iterator[pd.DataFrame]:
        """The nearest entry of each row (_list, _key, reach) within its reach, if none is nearer than `least`."""
        for name, rows in asked.groupby("_list", dropna=False):
            if name in self.of:
                trie, entries = self.of[name]
                keys = rows["_key"].tolist()
                best, d, _ = nearest(trie, keys, rows["reach"].to_numpy(np.int64), np.arange(len(entries)), least)
                hit = np.flatnonzero(best >= 0)
                found = entries.iloc[best[hit]]
                yield _texts(pd.DataFrame({"_list": name, "_key": [keys[i] for i in hit], "d": d[hit]} | {c: found[c].to_numpy() for c in self.order}))


def _tasks(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt over all tasks: they are few and small, so Spark would merge them into one, but each is much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join that deals out both sides. Of a written table Spark knows the size of its files, which hold keys that are
    alike in few bytes; it would take millions of rows for small and send them through the driver."""
    return rows.hint("merge")


def _by_broadcast(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """The nearest entry of each key (_list, _key, reach), from tries that every executor has."""
    context = asked.sparkSession.sparkContext
    lists = context.broadcast(entries.toArrow())  # as rows of Python objects they would take many times their bytes on the driver

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = None
        for batch in batches:
            tries = tries or _Lists(lists.value.to_pandas(), ["ord", "entry"])
            yield from tries.nearest(batch)

    return asked.repartition(context.defaultParallelism, "_key").mapInPandas(run, "_list string, _key string, d int, ord long, entry string")


def _one_edit(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(_list, _key, d, ord, entry) for the keys (_list, _key, q) that an entry (_list, _key, place) is one edit away from: the
    one of the least place.

    Two keys are one edit apart if they agree without their i-th characters, or one agrees with the other without its i-th.
    Both sides are cut in these ways and joined on a hash of what is left. Whether the hash told the truth is seen from
    the keys; a key that a false match stands in the way of is left out, and has to be looked up in another way.
    """
    cut = F.concat(F.substring("_key", F.lit(1), F.col("i") - 1), F.substring("_key", F.col("i") + 1, F.length("_key")))
    hashed = lambda at, left: F.xxhash64("_list", at, left)
    longer, shorter = F.lit(-1), F.lit(0)

    def ways(rows: DataFrame, name: str, whole: Column, with_cut: Column) -> DataFrame:
        rows = rows.select(name, "_list", "_key", F.explode(F.sequence(F.lit(0), F.length("_key"))).alias("i"))
        return rows.select(name, F.explode(F.when(F.col("i") == 0, F.array(hashed(whole, F.col("_key")))).otherwise(F.array(hashed(F.col("i"), cut), hashed(with_cut, cut)))).alias("h"))

    have = ways(entries, "place", shorter, longer).groupBy("h").agg(F.min("place").alias("place"))
    met = ways(asked, "q", longer, shorter).join(_shuffled(have), "h").groupBy("q").agg(F.min("place").alias("place"))
    entry = entries.select("place", F.col("_list").alias("its_list"), F.col("_key").alias("its_key"), "ord", "entry")
    found = asked.join(_shuffled(met), "q").join(_shuffled(entry), "place").where((F.col("_list") == F.col("its_list")) & (F.levenshtein("_key", "its_key") == 1))
    return found.select("_list", "_key", F.lit(1).alias("d"), "ord", "entry")


def _prefixes(shards: pd.DataFrame) -> list[str]:
    return [os.path.commonprefix([low, high]) for low, high in zip(shards["low"], shards["high"], strict=True)]


def _visits(asked: DataFrame, shards: Broadcast) -> DataFrame:
    """(_list, _key, reach, shard) for keys (_list, _key, reach): the shards that may have an entry as near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = {name: (rows["shard"].to_numpy(), _prefixes(rows)) for name, rows in shards.value.groupby("_list")}
        tries = {name: Trie(sorted(set(prefixes))) for name, (_, prefixes) in runs.items()}
        at = {name: pd.DataFrame({"prefix": np.unique(prefixes, return_inverse=True)[1], "shard": shard}) for name, (shard, prefixes) in runs.items()}
        for batch in batches:
            for name, rows in batch.groupby("_list"):
                if name not in runs:
                    continue
                keys, reach = rows["_key"].to_numpy(object), rows["reach"].to_numpy(np.int64)
                text, prefix, _ = tries[name].within(keys.tolist(), reach, prefixes=True)
                near = pd.DataFrame({"text": text, "prefix": prefix}).merge(at[name], on="prefix")
                yield _texts(pd.DataFrame({"_list": name, "_key": keys[near["text"]], "reach": reach[near["text"]], "shard": near["shard"].to_numpy()}))

    return asked.mapInPandas(run, "_list string, _key string, reach int, shard int")


def _by_shards(asked: DataFrame, entries: DataFrame, n_entries: int, shard_entries: int) -> DataFrame:
    """The nearest entry of each key (_list, _key, reach): by a join if it is one edit away, else from tries of runs of sorted entries.

    The distance rises round by round. A key visits the shards whose common prefix is within that of a beginning of the
    key, until an entry is found; once few keys are left, these go as far as they can. The driver gets a row for each shard.
    """
    # places count the entries in their order
    placed = written(entries.orderBy(F.asc_nulls_last("ord"), "entry").withColumn("place", F.monotonically_increasing_id()))
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()))
    best = written(_one_edit(asked, placed))
    sharded = written(placed.select("_list", "_key", "place").repartitionByRange(max(1, -(-n_entries // shard_entries)), "_list", "_key").withColumn("shard", F.spark_partition_id()))
    ends = sharded.groupBy("_list", "shard").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).toPandas()
    shards = asked.sparkSession.sparkContext.broadcast(ends)
    group = ["_list", "shard", "copy"]

    def look(keys: DataFrame, least: int) -> DataFrame:
        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = list(_Lists(right, ["place"]).nearest(left, least)) if len(left) and len(right) else []
            return _texts(pd.concat(found) if found else pd.DataFrame({"_list": [], "_key": [], "d": [], "place": []}))

        visits = written(_visits(_tasks(keys, "_key"), shards))
        copies = written(visits.groupBy("_list", "shard").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies")))
        dealt = visits.join(copies, ["_list", "shard"]).withColumn("copy", F.pmod(F.xxhash64("_key"), F.col("copies")).cast("int")).select(*group, "_key", "reach")
        asked_for = copies.select("_list", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        there = sharded.join(asked_for, ["_list", "shard"]).select(*group, "_key", "place")
        met = _tasks(dealt, *group).groupBy(group).cogroup(_tasks(there, *group).groupBy(group)).applyInPandas(meet, "_list string, _key string, d int, place long")
        met = met.groupBy("_list", "_key").agg(F.min(F.struct("d", "place")).alias("b")).select("_list", "_key", "b.*")
        return written(met.join(_shuffled(placed.select("place", "ord", "entry")), "place").select("_list", "_key", "d", "ord", "entry"))

    least, open_ = 2, asked.select("_list", "_key", "reach").where("reach > 1").join(_shuffled(best), ["_list", "_key"], "left_anti")
    while True:
        open_ = written(open_)
        n_open, farthest = open_.agg(F.count("*"), F.max("reach")).first()
        if not n_open:
            return best
        reach = farthest if n_open * len(ends) <= FEW else least + least // 4
        found = look(open_.withColumn("reach", F.least("reach", F.lit(reach))), least)
        best = best.unionByName(found)
        least, open_ = reach + 1, open_.where(F.col("reach") > reach).join(_shuffled(found), ["_list", "_key"], "left_anti")


def nearest_entry(readings: DataFrame, register: DataFrame, *, key: str, value: str = "value", list_name: str = "list_name", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """readings with gaz_value, gaz_matched and gaz_score from register (list_name, entry, ord).

    The nearest entry is the one of least edit distance between keys, ties to the lowest ord; only then its own length
    decides whether it is accepted. Readings that equal an entry's key are settled by an equi-join, in a large register
    those one edit away from one by another; distinct remaining keys are looked up in tries of the entries' keys, as far as
    an entry could be accepted. A blank reading or a list without
    entries is a miss; misses keep the reading. A null list is one that has no entries.
    """
    entries = register.select(F.col(list_name).alias("_list"), key_lower(F.col("entry")).alias("_key"), F.struct("ord", "entry").alias("e")).where("_list IS NOT NULL AND _key IS NOT NULL")
    entries = written(entries.groupBy("_list", "_key").agg(F.min("e").alias("e")).select("_list", "_key", F.col("e.ord").cast("long").alias("ord"), "e.entry"))
    n_entries, n_bytes = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_key") + F.octet_length("entry") + 16), F.lit(0))).first()
    rows = readings.withColumns({"_list": F.col(list_name), "_key": key_lower(F.trim(F.coalesce(value, F.lit(""))))})
    exact = entries.select("_list", "_key", F.col("entry").alias("_exact"))
    rows = rows.join(exact if n_bytes <= MAX_SENT_BYTES else _shuffled(exact), ["_list", "_key"], "left")
    asked = rows.where(F.col("_exact").isNull() & F.col("_list").isNotNull() & (F.col("_key") != "")).select("_list", "_key").distinct()
    asked = asked.withColumn("reach", F.pandas_udf(_reach, "int")(F.length("_key")))
    best = _by_broadcast(asked, entries) if n_bytes <= max_broadcast_bytes else _shuffled(_by_shards(asked, entries, n_entries, shard_entries))
    best = best.select("_list", "_key", F.struct("d", "ord", "entry", F.length(key_lower(F.col("entry"))).alias("n")).alias("_best"))
    longest = F.greatest(F.length("_key"), F.col("_best.n"))
    near = F.col("_best.d") <= F.greatest(F.lit(1), F.floor(longest * TOLERANCE))
    rows = rows.join(best, ["_list", "_key"], "left")
    hit = F.coalesce(F.when(F.col("_key") == "", False).when(F.col("_exact").isNotNull(), True).otherwise(near), F.lit(False))
    score = F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.bround(1 - F.col("_best.d") / F.greatest(longest, F.lit(1)), 3))
    return rows.select(*readings.columns, F.when(hit, F.coalesce("_exact", "_best.entry")).otherwise(F.trim(F.coalesce(value, F.lit("")))).alias("gaz_value"), hit.alias("gaz_matched"), F.when(hit, score).otherwise(0.0).alias("gaz_score"))


def apply_match(value: Column, confidence: Column, gaz_value: Column, matched: Column) -> tuple[Column, Column]:
    """(value, confidence) after snapping: a hit is adopted and sure, a miss of a non-blank reading is certain to be reviewed."""
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return F.when(matched, gaz_value).otherwise(value), F.when(matched, F.greatest(confidence, F.lit(SURE))).when(~blank, 0.0).otherwise(confidence)


def miss_pool(candidates: DataFrame, register: DataFrame, *, key: str, value: str = "value", list_name: str = "list_name") -> DataFrame:
    """misses() as a pool to draw from, which must not be empty."""
    pool = misses(candidates, register, key=key, value=value, list_name=list_name)
    if pool.isEmpty():
        raise ValueError("no candidate misses the register")
    return pool


def misses(candidates: DataFrame, register: DataFrame, *, key: str, value: str = "value", list_name: str = "list_name") -> DataFrame:
    """The candidates that snap to nothing."""
    return nearest_entry(candidates, register, key=key, value=value, list_name=list_name).where(~F.col("gaz_matched")).select(*candidates.columns)


def pool(names: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """The distinct keys (entry) of `least` to `most` letters, in order: what fits a comb."""
    return names.select(key_lower(F.col(value)).alias("entry")).where(F.length("entry").between(least, most)).distinct().orderBy("entry")
