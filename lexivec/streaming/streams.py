"""Streams: guarding messages, rate limits, session state, ingest of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexivec.compat import ship_package
from lexivec.operators.guard import validate_input
from lexivec.sources.readers import documents_of, extract


def guarded(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages with the checks' columns: stateless, so a batch and a stream give the same rows."""
    return validate_input(messages, text)


class RateLimit(StatefulProcessor):
    """Per user: how many requests passed in the open window, and when it closes, in milliseconds."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "n long, reset long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, reset = self.state.get() if self.state.exists() else (0, None)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        passed = []
        for at in events["at"].tolist():
            if reset is None or at > reset:
                n, reset, ok = 1, at + self.window_ms, True
            else:
                ok = n < self.most
                n += ok
            passed.append(bool(ok))
        self.state.update((int(n), int(reset)))
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"], "passed": passed})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, most: int = 50, window_ms: int = 60_000) -> DataFrame:
    """user_id, event_id, passed of a stream of requests (user_id, event_id, ts). Needs the RocksDB state store."""
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return d.groupBy("user_id").transformWithStateInPandas(RateLimit(most, window_ms), "user_id long, event_id long, passed boolean", "append", "none")


class SessionChunks(StatefulProcessor):
    """Per session: the citation number of each chunk, by its first appearance.

    Chunks not seen for the time to live may be forgotten and get a new number; no number is given twice, until the session
    is cleared: then all begins anew. A session may begin with the numbers that a table has for it.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("chunks", "chunk long", "citation long", self.ttl_ms)
        self.last = handle.getValueState("last", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for chunk, citation in zip(initialState["chunk"].tolist(), initialState["citation"].tolist()):
            self.seen.updateValue((int(chunk),), (int(citation),))
            self.last.update((max(int(citation), self.last.get()[0] if self.last.exists() else 0),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, out = self.last.get()[0] if self.last.exists() else 0, []
        events = pd.concat(list(rows)).sort_values(["seq", "chunk"])
        for chunk, clear in zip(events["chunk"].tolist(), events["clear"].tolist()):
            if clear:
                self.seen.clear()
                n = 0
            elif not pd.isna(chunk) and not self.seen.containsKey((int(chunk),)):
                n += 1
                self.seen.updateValue((int(chunk),), (n,))
                out.append((key[0], int(chunk), n))
        self.last.update((n,))
        yield pd.DataFrame(out, columns=["session", "chunk", "citation"])

    def close(self) -> None:
        pass


def _stateful(df: DataFrame) -> DataFrame:
    """df, once its session can run processors with state."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def session_citations(hits: DataFrame, ttl_ms: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """session, chunk, citation of new chunks in a stream of hits (session, seq, chunk).

    A column `clear` marks events that clear their session. known: (session, chunk, citation) that sessions begin with, as
    an earlier run left them; read when the stream first starts. `retrieval.citations_between` gives the same of a table.
    """
    d = _stateful(hits)
    clear = F.coalesce(F.col("clear").cast("boolean"), F.lit(False)) if "clear" in d.columns else F.lit(False)
    d = d.select("session", "seq", "chunk", clear.alias("clear"))
    mode = "ProcessingTime" if ttl_ms else "none"
    first = None if known is None else known.select("session", "chunk", "citation").groupBy("session")
    return d.groupBy("session").transformWithStateInPandas(SessionChunks(ttl_ms), "session long, chunk long, citation long", "append", mode, first)


class AnswerParts(StatefulProcessor):
    """Per message: the parts of its answer, until its marks of start and finish and all parts between them are there.

    Parts may come in any order and more than once. A finished message is kept as such, for the time to live if there is one,
    so that what comes late gives no second answer.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int", "text string")
        self.ends = handle.getValueState("ends", "started long, finished long, n int")
        self.done = handle.getValueState("done", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["session", "message", "answer", "started_ms", "finished_ms"]
        if self.done.exists():
            yield pd.DataFrame([], columns=columns)
            return
        started, finished, n = self.ends.get() if self.ends.exists() else (None, None, None)
        for r in pd.concat(list(rows)).itertuples():
            if r.kind == "start":
                started = int(r.ms) if started is None else min(started, int(r.ms))
            elif r.kind == "finish":
                finished, n = int(r.ms), int(r.part)
            elif r.kind == "text":
                self.parts.updateValue((int(r.part),), (r.text or "",))
        held = {int(k[0]): v[0] for k, v in self.parts.iterator()}
        if n is None or started is None or any(k not in held for k in range(n)):
            self.ends.update((started, finished, n))
            yield pd.DataFrame([], columns=columns)
            return
        self.parts.clear()
        self.ends.clear()
        self.done.update((True,))
        yield pd.DataFrame([(key[0], key[1], "".join(held[k] for k in range(n)), started, finished)], columns=columns)

    def close(self) -> None:
        pass


def assembled(parts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """session, message, answer, started_ms, finished_ms of a stream of parts (session, message, part, kind, text, ms).

    kind: start, text, or finish; a text's part counts from 0, a finish's is how many texts there are. Each finished message
    is one row, once. ttl_ms: how long a finished message is remembered, for queries that run on; one that reads what is there
    and ends (availableNow) would wait for the time to pass.
    """
    d = _stateful(parts).select("session", "message", "part", "kind", "text", "ms")
    return d.groupBy("session", "message").transformWithStateInPandas(
        AnswerParts(ttl_ms), "session long, message long, answer string, started_ms long, finished_ms long", "append", "ProcessingTime" if ttl_ms else "none"
    )


def persisted(rows: DataFrame, path: str, checkpoint: str, also=None):
    """A query that writes a stream to folders by batch number: a batch that runs again after a failure replaces its own.

    also: called with what was written, and the batch's number, after each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if also is not None:
            also(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}"), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, chunker=None):
    """A query that reads new files of a folder, writes their documents, and with a chunker their chunks.

    Files are extracted once: chunks are cut from the documents as they were written. Both lie in folders by batch number,
    so a batch that runs again after a failure leaves no second copy.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def cut(docs: DataFrame, number: int) -> None:
        done = docs.filter("processing_status = 'completed'").select(F.xxhash64("doc_id").alias("doc_id"), F.col("content").alias("text"))
        chunker(done).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        docs = documents_of(extract(batch.select("path", "length", "content")))
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        if chunker is not None:
            cut(spark.read.schema(docs.schema).parquet(f"{out}/documents/batch={number}"), number)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def answered(questions: DataFrame, answer, path: str, checkpoint: str):
    """A query that answers a stream of questions micro-batch by micro-batch and appends them to a table.

    answer(batch) gives session, answer and what else is kept; each batch is written once: a batch that is run again after a
    failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("finished_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def traced(calls: DataFrame, path: str, checkpoint: str):
    """A query that appends an agent's finished calls (session, at, kind, tokens, started) to a table; `agent.trace` orders
    them there."""
    return calls.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def polled(query, seconds: int = 5):
    """A stream's writer that looks for new input at intervals."""
    return query.trigger(processingTime=f"{seconds} seconds")
