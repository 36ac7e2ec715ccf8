"""Live forms: pages arrive one by one, a form goes out with both of them, and again whenever a page comes late or anew.

The state of a form is its newest first and second page. A form with one page waits for the other until the watermark has passed
its arrival by `wait`, then goes out alone; its state stays for `keep`, so that a late page still finds the other one. Each time
a form goes out it has a higher version. Forms are dealt into buckets by a hash of their id; the forms of a bucket are one value
of the state store and have one timer, the next time that any of them is due, as a call to the store costs milliseconds whatever
it brings. The sink writes a folder for each batch and replaces it when a batch is run again, so a restart from the checkpoint
neither loses nor repeats a form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PAGE = "form_id string, page int, arrived timestamp, fields map<string,string>"
_OUT = "form_id string, version int, status string, fields string"
_STATE = "forms string, due long"
#: Buckets of forms. A page that comes has the state of its bucket written anew: one part in so many of the forms that are kept.
BUCKETS = 8192
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PairPages(StatefulProcessor):
    """The newest page of each number by arrival, ties to the greater text; times in milliseconds.

    A bucket's forms are kept as form_id -> [t1, p1, t2, p2, version, alone_at]: a form that has not gone out goes alone at alone_at.
    """

    def __init__(self, wait: int, keep: int) -> None:
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bucket = handle, handle.getValueState("bucket", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        forms, due = self._held()
        newest: dict[str, dict] = {}
        for batch in rows:
            for form_id, page, at, text in zip(batch["form_id"], batch["page"], batch["at"], batch["fields"], strict=True):
                if page in (1, 2):
                    pages = newest.setdefault(form_id, {})
                    pages[page] = max(pages.get(page, (-1, "")), (int(at), text))
        out, changed = [], False
        for form_id, pages in newest.items():
            t1, p1, t2, p2, version, alone_at = before = forms.get(form_id) or [None, None, None, None, 0, None]
            now = [*self._newer(t1, p1, pages.get(1)), *self._newer(t2, p2, pages.get(2))]
            if now == before[:4]:
                continue
            goes = None not in (now[0], now[2]) or version > 0
            if alone_at is None:
                alone_at = max(t for t in (now[0], now[2]) if t is not None) + self.wait
            forms[form_id], changed = [*now, version + goes, alone_at], True
            if goes:
                out.append((form_id, version + 1, now[1], now[3]))
        if changed:
            self._keep(forms, due)
        if out:
            yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (forms, due), now, out = self._held(), timerValues.getCurrentWatermarkInMs(), []
        if due is None or due > now:
            return
        for form_id, form in list(forms.items()):
            if form[4] == 0 and form[5] <= now:
                form[4] = 1
                out.append((form_id, 1, form[1], form[3]))
            if form[4] > 0 and self._gone_at(form) <= now:
                del forms[form_id]
        self._keep(forms, None)  # the timer that came is over
        if out:
            yield self._out(out)

    def _held(self) -> tuple[dict[str, list], int | None]:
        held = self.bucket.get()
        return (json.loads(held[0]), held[1]) if held else ({}, None)

    def _keep(self, forms: dict[str, list], due: int | None) -> None:
        """The state of the bucket, with a timer in place of the one at `due`."""
        if not forms:
            if due is not None:
                self.handle.deleteTimer(due)
            self.bucket.clear()
            return
        next_ = min(form[5] if form[4] == 0 else self._gone_at(form) for form in forms.values())
        if next_ != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(next_)
        self.bucket.update((json.dumps(forms, ensure_ascii=False), next_))

    def _gone_at(self, form: list) -> int:
        return max(t for t in (form[0], form[2]) if t is not None) + self.keep

    @staticmethod
    def _newer(at: int | None, text: str | None, page: tuple[int, str] | None) -> tuple[int | None, str | None]:
        return (at, text) if page is None else page if at is None else max((at, text), page)

    def _out(self, forms: list[tuple]) -> pd.DataFrame:
        form_id, version, first, second = zip(*forms, strict=True)
        status = ["complete" if None not in (p1, p2) else "first page only" if p2 is None else "second page only" for p1, p2 in zip(first, second, strict=True)]
        fields = [json.dumps(json.loads(p1 or "{}") | json.loads(p2 or "{}"), ensure_ascii=False, sort_keys=True) for p1, p2 in zip(first, second, strict=True)]
        return pd.DataFrame({"form_id": form_id, "version": version, "status": status, "fields": fields})


def live_forms(pages: DataFrame, wait: str = "10 minutes", keep: str = "30 days", delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(form_id, version, status, fields) of a stream of pages (form_id, page, arrived, fields).

    Pages may come in any order as long as their arrival times are less than `delay` behind the newest one (Spark drops the
    others). Where both pages have a field, the second one's counts, null values included. Rows without form_id or arrived time, and
    pages other than 1 and 2, only move the watermark. Other columns are ignored. A checkpoint holds for one number of buckets.
    """
    milliseconds = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = pages.select(F.coalesce("form_id", F.lit("")).alias("form_id"), "page", "arrived", F.unix_millis("arrived").alias("at"), F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields")).withWatermark("arrived", delay)
    rows = rows.withColumn("page", F.when(F.col("form_id") != "", F.col("page"))).withColumn("fields", F.coalesce("fields", F.lit("{}"))).where("arrived IS NOT NULL")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("form_id"), F.lit(buckets)))
    out = rows.groupBy("bucket").transformWithStateInPandas(PairPages(milliseconds(wait), milliseconds(keep)), _OUT, "Append", "EventTime")
    return out.withColumn("fields", F.from_json("fields", "map<string,string>"))


def start(forms: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over all pages that are there, into one folder of `out` for each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark = forms.sparkSession
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        return forms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it was started with
        spark.conf.set(_STORE[0], before) if before else spark.conf.unset(_STORE[0])


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(form_id, version, status, fields) as each form went out last."""
    rows = spark.read.schema(f"{_OUT.replace('fields string', 'fields map<string,string>')}, batch long").parquet(out)
    newest = rows.groupBy("form_id").agg(F.max_by(F.struct("version", "status", "fields"), F.struct("batch", "version")).alias("form"))
    return newest.select("form_id", "form.*")
