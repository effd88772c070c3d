"""What analysts decide on leads: a keyed state with its history, both kept by the batch that changed them.

Each batch of updates writes the next version of the state and the events that led to it; both are named by the batch, so
a batch that is run again after a failure replaces what it had begun and changes nothing else, and a workbench that is
opened anew goes on from the last version that is whole. ``stream`` makes each micro-batch such a batch. Updates of a lead
are applied one after another in a sorted stream: an update whose author had seen an older version of the lead than there
is now is refused and told so. Only leads that a batch updates pass through Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cairnlake.sources.scratch import stored

#: What is kept of a lead, and what a new one begins with.
STATE = ("status", "analyst_notes", "reviewer", "review_date", "disposition", "follow_up_needed", "bookmark", "priority_override", "needs_review", "last_reviewed_at", "last_exported_at", "updated_at")
NEW = {"status": "NEW", "bookmark": "false", "needs_review": "true"}
EVENTS = ("event_type", "previous_status", "new_status", "reviewer", "note", "occurred_at", "details")
STATE_DDL = ", ".join(f"{c} string" for c in ("lead_id", *STATE))
HISTORY_DDL = ", ".join(f"{c} string" for c in ("lead_id", *EVENTS)) + ", nth int"
UPDATES_DDL = "lead_id string, at string, seq long, seen string, action string, reviewer string, changes map<string,string>"


def folded(state: dict[str, str], updates: Iterator[dict]) -> Iterator[dict]:
    """The events of a lead's updates in order; ``state`` ends as the last one leaves it."""
    for u in updates:
        changes, was = dict(u["changes"] or {}), state["status"]
        who = u["reviewer"] or changes.get("reviewer") or ""
        event = lambda kind, note="", details="", u=u, was=was, who=who: {"event_type": kind, "previous_status": was if kind != "EXPORTED" else "", "new_status": state["status"] if kind != "EXPORTED" else "", "reviewer": who, "note": note, "occurred_at": u["at"], "details": details}
        if u["seen"] and state["updated_at"] and u["seen"] < state["updated_at"]:
            yield event("REFUSED", details=f"changed at {state['updated_at']}, seen at {u['seen']}")
            continue
        if u["action"] == "EXPORT":
            state["last_exported_at"] = state["updated_at"] = u["at"]
            yield event("EXPORTED")
            continue
        state.update({k: v for k, v in changes.items() if k in STATE})
        state["updated_at"] = u["at"]
        note = changes.get("analyst_notes") or ""
        if changes.get("status") and changes["status"] != was:
            yield event("STATUS_CHANGED", note)
        if note:
            yield event("NOTE_ADDED", note)


class Workbench:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _whole(self, kind: str) -> list[int]:
        """The batches of which all of a kind is written."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(re.search(r"batch=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found)

    def last(self, before: int | None = None) -> int | None:
        """The last batch that is whole (and came before another): its state is written last."""
        return max((b for b in self._whole("state") if before is None or b < before), default=None)

    def state(self, before: int | None = None) -> DataFrame:
        at = self.last(before)
        return self.spark.createDataFrame([], STATE_DDL) if at is None else self.spark.read.schema(STATE_DDL).parquet(f"{self.folder}/state/batch={at}")

    def history(self) -> DataFrame:
        """(lead_id, event, ..., nth, batch) of all whole batches."""
        done, whole = self.last(), self._whole("history")
        paths = [f"{self.folder}/history/batch={b}" for b in whole if done is not None and b <= done]
        if not paths:
            return self.spark.createDataFrame([], HISTORY_DDL + ", batch int")
        return self.spark.read.schema(HISTORY_DDL + ", batch int").option("basePath", f"{self.folder}/history").parquet(*paths)

    def create(self, leads: DataFrame, at: str, batch: int) -> None:
        """Leads (lead_id, title) that have no state yet begin one; the others keep theirs."""
        now = self.state(batch)
        fresh = leads.where(F.trim("lead_id") != "").groupBy("lead_id").agg(F.min("title").alias("title")).join(now.select("lead_id"), "lead_id", "left_anti")
        fresh = stored(fresh, "fresh-leads")
        begun = fresh.select("lead_id", *[F.lit(at if c == "updated_at" else NEW.get(c, "")).alias(c) for c in STATE])
        told = {"event_type": "CREATED", "new_status": NEW["status"], "occurred_at": at}
        events = fresh.select("lead_id", *[F.coalesce("title", F.lit("")).alias(c) if c == "details" else F.lit(told.get(c, "")).alias(c) for c in EVENTS], F.lit(0).alias("nth"))
        self._commit(batch, now.unionByName(begun), events)

    def apply(self, updates: DataFrame, batch: int) -> None:
        """Applies updates (``UPDATES_DDL``) by lead in the order of ``at`` and ``seq``."""
        now, updates = self.state(batch), stored(updates.where(F.trim("lead_id") != ""), "updates")
        touched = updates.select("lead_id").distinct()
        blank = lambda ddl: [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in ddl)]
        rest = [x for x in UPDATES_DDL.split(", ") if not x.startswith("lead_id")]
        old = now.join(touched, "lead_id", "left_semi").select("lead_id", F.lit(0).alias("tag"), F.struct(*STATE).alias("state"), *blank(rest))
        state_type = old.schema["state"].dataType
        new = updates.select("lead_id", F.lit(1).alias("tag"), F.lit(None).cast(state_type).alias("state"), *[x.split()[0] for x in rest])
        streams = old.unionByName(new).repartition("lead_id").sortWithinPartitions("lead_id", "tag", "at", "seq")
        fields = ["lead_id", "tag", *STATE, *[f"e_{c}" for c in EVENTS], "nth"]
        schema = pa.schema([(c, pa.int32() if c in ("tag", "nth") else pa.string()) for c in fields])

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            out = []
            for lead_id, mine in groupby(rows, key=lambda r: r["lead_id"]):
                first = next(mine)
                state = {c: NEW.get(c, "") for c in STATE} | ({k: v or "" for k, v in first["state"].items()} if first["tag"] == 0 else {})
                for nth, e in enumerate(folded(state, mine if first["tag"] == 0 else _with(first, mine))):
                    out.append({"lead_id": lead_id, "tag": 1, "nth": nth, **{f"e_{c}": v for c, v in e.items()}})
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                out.append({"lead_id": lead_id, "tag": 0, **state})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

        ddl = ", ".join(f"{c} {'int' if c in ('tag', 'nth') else 'string'}" for c in fields)
        done = stored(streams.mapInArrow(applied, ddl), "applied")
        after = now.join(touched, "lead_id", "left_anti").unionByName(done.where("tag = 0").select("lead_id", *STATE))
        self._commit(batch, after, done.where("tag = 1").select("lead_id", *[F.col(f"e_{c}").alias(c) for c in EVENTS], "nth"))

    def stream(self, updates: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies a stream of updates, batch by batch after those that are there, until what is there now has been read."""
        first = (self.last() or 0) + 1 if not self._begun(checkpoint) else self._begun(checkpoint)
        self._begin(checkpoint, first)
        return updates.writeStream.foreachBatch(lambda rows, n: self.apply(rows, first + n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _begun(self, checkpoint: str) -> int | None:
        """The number that the first micro-batch of a checkpoint had."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-first-*")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return next((int(f.getPath().getName().rsplit("-", 1)[1]) for f in found), None)

    def _begin(self, checkpoint: str, first: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-first-{first}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def _commit(self, batch: int, state: DataFrame, events: DataFrame) -> None:
        events.write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch}")
        state.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")  # last: from here on the batch counts


def _with(first: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield first
    yield from rest
