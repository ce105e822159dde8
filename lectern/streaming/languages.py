"""The language of a document's pages as they arrive, in any order.

The first page of a document whose language is found decides for it and all
later pages, so a page can be answered once all before it have come. Pages that
are ahead wait in the document's state; a timer gives up on pages that stay away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "doc_id bigint, page_number int, language string"
#: How long a page waits for one before it, from the batch that brought it.
PATIENCE = "10 minutes"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageLanguages(StatefulProcessor):
    """Answers a document's pages in order of their number.

    State of a document: the page that is next, the language once one is found, and
    the pages that wait. With a requested language that one is the answer.
    """

    def __init__(self, first_page: int, patience_ms: int):
        self.first_page, self.patience_ms = first_page, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next int, language string, timer bigint")
        self.waiting = handle.getMapState("waiting", "page_number int", "requested string, found string")

    def _answered(self, doc_id: int, place: tuple, pages: list[tuple]) -> tuple[tuple, list]:
        """place after pages (number, requested, found) in order, and their rows."""
        number, language, timer = place
        rows = []
        for page, requested, found in pages:
            language = language or found
            rows.append((doc_id, page, requested or language))
            number = max(number, page + 1)
        return (number, language, timer), rows

    def _in_turn(self, doc_id: int, place: tuple) -> tuple[tuple, list]:
        """Answers the waiting pages that follow one another from the next page on."""
        rows = []
        while self.waiting.containsKey((place[0],)):
            number = place[0]
            requested, found = self.waiting.getValue((number,))
            self.waiting.removeKey((number,))
            place, more = self._answered(doc_id, place, [(number, requested, found)])
            rows += more
        return place, rows

    def _set_timer(self, place: tuple, now: int, rearm: bool) -> None:
        """A timer while pages wait, none else; after an answer the patience begins anew."""
        waits, timer = next(iter(self.waiting.keys()), None) is not None, place[2]
        if timer and (rearm or not waits):
            self.handle.deleteTimer(timer)
            timer = 0
        if waits and not timer:
            timer = now + self.patience_ms
            self.handle.registerTimer(timer)
        self.place.update((place[0], place[1], timer))

    def _given(self) -> tuple:
        return tuple(self.place.get()) if self.place.exists() else (self.first_page, None, 0)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "page_number", "language"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        doc_id, place, out, now = key[0], self._given(), [], 0
        for batch in rows:
            clean = batch.astype(object).where(batch.notna(), None)
            now = max(now, int(batch.iloc[:, -1].max().timestamp() * 1000))  # the time of arrival, whose name Spark does not keep
            for page, requested, found in zip(clean["page_number"], clean["requested"], clean["found"], strict=True):
                if page < place[0]:  # given up before, or once more: answered with what is known
                    out.append((doc_id, page, requested or place[1]))
                else:
                    self.waiting.updateValue((int(page),), (requested, found))
        place, more = self._in_turn(doc_id, place)
        self._set_timer(place, now, bool(more))
        yield self._frame(out + more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Gives up on the pages before the first that waits."""
        number, language, _ = self._given()
        ahead = min((k[0] for k in self.waiting.keys()), default=number)
        place, rows = self._in_turn(key[0], (ahead, language, 0))
        self._set_timer(place, expiredTimerInfo.getExpiryTimeInMs(), True)
        yield self._frame(rows)


def page_languages(pages: DataFrame, first_page: int = 1, patience: str = PATIENCE) -> DataFrame:
    """(doc_id, page_number, language) of a stream of pages (doc_id, page_number, requested, found).

    The rows that ``language.document_language`` has of the whole table, whatever
    order the pages come in: the requested language, else the first that this page or
    one before it found. Pages that are ahead wait ``patience`` for those before
    them, in time of arrival: as that only grows, the watermark drops no page. One
    that arrives after it was given up, or a second time, is answered with what is
    known by then. Pages without a number have no
    place in a document and are left out.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = pages.where(F.col("page_number").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "requested", "found", F.current_timestamp().alias("_at"),
    )
    return rows.withWatermark("_at", "0 seconds").groupBy("doc_id").transformWithStateInPandas(PageLanguages(first_page, wait), OUTPUT, "Append", "EventTime")
