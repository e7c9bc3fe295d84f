"""Structured Streaming forms of the continuous flows; each ends with the result of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from engram.operators import evaluation, graph
from engram.params import DEFAULTS
from engram.sources import snapshots
from engram.sources.stage_tables import materialize


#: What keeps the state of list and map kind.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Transcript(StatefulProcessor):
    """The lines of one session that its transcript shows, by place, and the numbers of those that it doesn't.

    A line is kept while it can reach into the head or the tail half. What has left both can't come back, whatever comes
    later and wherever its place is, so a session never holds much more than the cap, and lines may come in any order.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "place long, line string", "times int")
        self.known = handle.getValueState("known", "chars long, place long, conclusion string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chars, answered, conclusion = self.known.get() if self.known.exists() else (0, -1, "")
        held = {(k[0], k[1]): v[0] for k, v in self.lines.iterator()}
        before = dict(held)
        for batch in rows:
            for place, role, text in zip(batch["place"], batch["role"], batch["text"], strict=True):
                if not text:
                    continue
                place, line = int(place), f"[{role}] {text}"
                held[place, line] = held.get((place, line), 0) + 1
                chars += len(line) + 1
                if role == "assistant" and (place > answered or place == answered and text > conclusion):
                    answered, conclusion = place, text
            held = self._shown(held, chars)
        for k in before.keys() - held.keys():
            self.lines.removeKey(k)
        for k, n in held.items():
            if before.get(k) != n:
                self.lines.updateValue(k, (n,))
        self.known.update((chars, answered, conclusion))
        yield pd.DataFrame({"session_id": [key[0]], "raw_content": [self._text(held, chars)], "conclusion": [conclusion[:300]], "status": ["pending"]})

    def _shown(self, held: dict, chars: int) -> dict:
        """The lines that reach into the first or last half, or all while the transcript is within the cap."""
        if chars - 1 <= self.cap:
            return held
        half, out = self.cap // 2, {}
        for order in (sorted(held), sorted(held, reverse=True)):
            used = 0
            for k in order:
                if used >= half:
                    break
                out[k] = held[k]
                used += (len(k[1]) + 1) * held[k]
        return out

    def _text(self, held: dict, chars: int) -> str:
        whole = "\n".join(line for (_, line), n in sorted(held.items()) for _ in range(n))
        half = self.cap // 2
        return whole[:half] + "\n...\n" + whole[len(whole) - half :] if chars - 1 > self.cap else whole

    def close(self) -> None:
        pass


def transcripts(messages: DataFrame, cap: int = DEFAULTS.transcript_chars) -> DataFrame:
    """session_id, raw_content, conclusion, status after every batch of messages (session_id, place, role, text).

    Lines stand in order of place, in whatever order they came; head and tail are kept within the cap; the answer with the
    last place is the conclusion.
    """
    messages.sparkSession.conf.set(*STATE_STORE)
    return messages.groupBy("session_id").transformWithStateInPandas(Transcript(cap), "session_id long, raw_content string, conclusion string, status string", "Update", "None")


class Replay(StatefulProcessor):
    """Version of one entity, and whether it is deleted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entity = handle.getValueState("entity", "version long, gone boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, gone = self.entity.get() if self.entity.exists() else (0, False)
        events = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        sequence, outcome, versions = [], [], []
        for s, operation, base, new in zip(events["sequence"], events["operation"], events["base_version"], events["version"], strict=True):
            if operation == "delete":
                what, version, gone = "deleted", max(int(new), version) if gone else int(new), True
            elif gone:
                what = "ignored"
            elif int(base) == version:
                what, version = "accepted", int(new)
            else:
                what = "conflict"
            sequence.append(int(s))
            outcome.append(what)
            versions.append(version)
        self.entity.update((version, gone))
        yield pd.DataFrame({"entity_id": key[0], "sequence": sequence, "outcome": outcome, "version": versions})

    def close(self) -> None:
        pass


def replay(events: DataFrame) -> DataFrame:
    """entity_id, sequence, outcome (accepted, conflict, ignored, deleted) and version of every event as it comes.

    A delete wins: later events of its entity are ignored. What was accepted before a late delete can't be taken back,
    so a sink keyed by entity holds the batch result, while this audit may differ from it.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    return events.groupBy("entity_id").transformWithStateInPandas(Replay(), "entity_id long, sequence long, outcome string, version long", "Append", "None")


def feedback(lists: DataFrame, table: str, active: DataFrame, checkpoint: str):
    """Recall lists into co-recall edges: each batch makes the next generation of the edge table.

    A batch that is run again after a failure starts from the generation before it, so that it counts once.
    """
    spark = active.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = number + 1  # the table starts as generation 1, and batch n writes generation n + 2
        edges = snapshots.read(spark, table, before)
        grown = graph.feedback(edges, batch, ["list_id"], active)
        grown.write.mode("overwrite").parquet(f"{table}/generation={before + 1}")
        spark.createDataFrame([(before + 1,)], "generation long").coalesce(1).write.mode("append").json(f"{table}/pointer")

    return lists.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)


def diagnostics(rows: DataFrame, root: str, stages: list[str], checkpoint: str, n: int = 200, by: str = "mode", at: str = "ts", tie: str = "request_id"):
    """Keep every diagnostic in an append-only table, and a summary of the n latest of each mode in a store.

    The store holds those n rows of each mode (`recent`), so that a batch reads them and itself and never the table; a
    batch that comes again after a failure counts once in all three.
    """
    spark = rows.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = snapshots.state(spark, root)
        if before.batches.get("diagnostics", -1) >= number:
            return
        snapshots.append(batch, f"{root}/rows", at, number)
        kept = snapshots.table(spark, root, "recent", before)
        seen = batch if kept is None else kept.unionByName(batch.select(*kept.columns))
        recent = materialize(evaluation.last_n(seen, n, by, at, tie), "recent")
        snapshots.commit(spark, root, {"recent": recent, "summary": evaluation.percentiles(recent, stages, by)}, job="diagnostics", batch=number, before=before)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)
