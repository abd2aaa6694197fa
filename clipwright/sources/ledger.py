"""A keyed sink that holds every row exactly once, whatever breaks off.

Each micro-batch is written to a folder of its own and counts only once a line for (query,
batch) stands in the ledger beside the data. Readers follow the ledger, so what a broken
run left behind is never seen, and a batch that is replayed after its line was written is
not written again. Every so many batches what is there is written together, as one folder
whose line takes the place of all before it; so neither the list of folders nor that of
small files grows with the time that a stream has run.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from clipwright.sources.sinks import exists
from clipwright.sources.tables import fresh_path

log = logging.getLogger(__name__)

#: Batches after which the folders of a query are written together.
TOGETHER = 50


class Ledger:
    """The committed folders of one query under ``root``.

    Lines are files named by batch, ``.all`` after those that replace what came before; they
    appear by a rename that fails if the name is there.
    """

    def __init__(self, spark: SparkSession, root: str, query: str):
        self.spark, self.root, self.query = spark, root.rstrip("/"), query
        self.lines = f"{self.root}/_ledger/{query}"

    def _hadoop(self) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs

    def _names(self) -> list[str]:
        if not exists(self.spark, self.lines):
            return []
        place = self._hadoop().Path(self.lines)
        store = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(n for f in store.listStatus(place) if not (n := f.getPath().getName()).startswith((".", "_")))

    def batches(self) -> set[int]:
        """Numbers of the batches that are committed, as far back as lines are kept."""
        return {int(n.partition(".")[0]) for n in self._names()}

    def folders(self) -> list[str]:
        """Folders of the rows that count: at most ``together`` of them, see ``exactly_once``."""
        names = self._names()
        whole = max((i for i, n in enumerate(names) if n.endswith(".all")), default=0)
        # The line of a batch sorts before the one that writes all up to it together.
        needed = [f"{self.lines}/{n}" for n in names[whole:]]
        if not needed:
            return []
        return [f"{self.root}/{r.folder}" for r in self.spark.read.schema("folder string, rows long").json(needed).collect()]

    def commit(self, batch: int, folder: str, rows: int, whole: bool = False) -> bool:
        """Writes the line; False if another run of the batch was first."""
        hadoop, name = self._hadoop(), f"{batch:020d}" + ".all" * whole
        draft = hadoop.Path(f"{self.lines}/_{name}-{folder.rpartition('/')[2]}")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        store = draft.getFileSystem(conf)
        out = store.create(draft, True)
        out.write(bytearray((json.dumps({"folder": folder, "rows": rows}) + "\n").encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        kind = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            hadoop.FileContext.getFileContext(store.getUri(), conf).rename(draft, hadoop.Path(f"{self.lines}/{name}"), options)
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" not in str(problem.java_exception.getClass().getName()):
                raise
            store.delete(draft, False)
            return False
        return True


def committed(spark: SparkSession, root: str, query: str, schema: StructType) -> DataFrame:
    """The rows that a query has committed; none before its first batch."""
    folders = Ledger(spark, root, query).folders()
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_once(rows: DataFrame, batch: int, root: str, query: str, key: list[str], together: int = TOGETHER, before_commit: Callable[[int], None] | None = None) -> bool:
    """Commits the rows of ``rows`` whose key is not there yet; False if the batch is there already.

    Of rows that share a key inside a batch one stays; null keys equal each other. A call
    that is broken off leaves nothing that counts and is repeated under the same number.
    ``before_commit`` is called when the rows are written and not yet committed.
    """
    spark, schema = rows.sparkSession, rows.schema
    ledger = Ledger(spark, root, query)
    names = ledger.batches()
    if batch in names:
        return False
    there = committed(spark, root, query, schema)
    # Only keys of this batch are taken out of what is there; the planner broadcasts them where
    # their measured size allows it.
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    fresh = rows.dropDuplicates(key)
    if names:
        keys = fresh.select(*key)
        hits = there.select(*key).join(keys, same(there, keys), "left_semi").distinct()
        fresh = fresh.join(hits, same(fresh, hits), "left_anti")
    path = fresh_path(spark, "batch").rpartition("/")[2]
    fresh.write.parquet(f"{ledger.root}/{query}/{path}")
    n = spark.read.schema(schema).parquet(f"{ledger.root}/{query}/{path}").count()
    if before_commit:
        before_commit(batch)
    won = ledger.commit(batch, f"{query}/{path}", n)
    if won and together and (batch + 1) % together == 0:
        _write_together(ledger, batch, schema)
    return won


def _write_together(ledger: Ledger, batch: int, schema: StructType) -> None:
    """All committed rows as one folder. If this is broken off, the lines before still hold;
    the next time takes it up. Folders that it replaces stay for readers that are under way."""
    rows = committed(ledger.spark, ledger.root, ledger.query, schema)
    path = fresh_path(ledger.spark, "whole").rpartition("/")[2]
    rows.write.parquet(f"{ledger.root}/{ledger.query}/{path}")
    ledger.commit(batch, f"{ledger.query}/{path}", -1, whole=True)


def exactly_once(
    stream: DataFrame, root: str, query: str, key: list[str], state: str, emit: Callable[[DataFrame, int], None] | None = None, together: int = TOGETHER,
    before_commit: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Runs a stream over all that is there into the keyed sink.

    ``emit`` is handed every committed batch; what it raises is logged and the stream goes
    on. A failure before the commit stops the stream: started again with the same ``state``,
    Spark replays the batch, under its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        write_once(batch, number, root, query, key, together, before_commit)
        if emit:
            try:
                emit(batch, number)
            except Exception:  # noqa: BLE001 - a listener does not stop the stream
                log.exception("listener failed on batch %d", number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
