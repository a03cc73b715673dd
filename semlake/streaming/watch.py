"""Subscriptions over a stream of operations: the state of each object is kept, and each operation is judged by the object
before and after it, as in the batch form."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semlake.functions.values import TYPES, Value
from semlake.operators.ontology import Ontology
from semlake.operators.watch import EVENTS, Subscription, _tags_for
from semlake.plans import algebra as A

OUTPUT = "sub_id long, lsn long, physical_ns long, logical int, node int, oid long, tag string, step int, kind string"


def watch_stream(ops: DataFrame, subs: list[Subscription], ontology: Ontology, watermark: str | None = None) -> DataFrame:
    """Events of all subscriptions, masked by interest; retention belongs to the sink that collects them.

    State is kept by object: tags that are set and removed, attribute values, relations. Operations of one micro-batch are
    sorted before they are applied; ordering between batches is the source's. An lsn that is no larger than the largest one
    of an earlier batch is a replay and changes nothing.

    watermark: how far operations' times may lie behind the latest one. Operations further behind are dropped, and a deleted
    object's state goes once the watermark has passed its deletion; without one, state is kept for good.
    """
    closure = {t: sorted(ontology.closure(t)) for t in ontology.tags}
    below = {n.tag: sorted(ontology.descendants(n.tag)) for s in subs for n in A.walk(s.query) if isinstance(n, A.IsA)}
    asked = {s.id: _tags_for(s.query, ontology) for s in subs}

    def view(state: dict) -> A.View:
        direct = set(state["tags"])
        implied = {a for t, at in state["tags"].items() for a in closure.get(t, [t]) if at > state["removed"].get(a, -1)}
        attrs = [(k, Value(t, base64.b64decode(v) if t == "blob" else v, c)) for k, t, v, c in state["attrs"]]
        return A.View(implied | direct, direct, attrs, {tuple(r) for r in state["rels"]}, not state["gone"])

    def member(s: Subscription, state: dict) -> bool:
        return not state["gone"] and state["n"] > 0 and A.matches(s.query, view(state), lambda t: below.get(t, [t]))

    def apply(r, state: dict) -> None:
        state["n"] += 1
        if r.op == "delete":
            state["gone"] = True
        elif r.op == "add_tag":
            state["tags"][r.tag] = state["n"]
        elif r.op == "remove_tag":
            state["tags"].pop(r.tag, None)
            state["removed"][r.tag] = state["n"]
        elif r.op in ("set_attr", "remove_attr"):
            raw = getattr(r, TYPES[r.v_type])
            raw = int(raw) if r.v_type in ("int", "timestamp") else base64.b64encode(raw).decode() if r.v_type == "blob" else raw
            item = [r.key, r.v_type, raw, r.v_ctx if isinstance(r.v_ctx, str) else None]
            state["attrs"] = [x for x in state["attrs"] if x != item] + [item] * (r.op == "set_attr")
        elif r.op in ("add_relation", "remove_relation"):
            edge = [r.key, int(r.target)]
            state["rels"] = [x for x in state["rels"] if x != edge] + [edge] * (r.op == "add_relation")

    def kinds(r, s: Subscription, before: bool, after: bool) -> list[str]:
        if not before and after:
            return ["Created" if r.op == "create" else "Entered"]
        if before and not after:
            if r.op == "delete":
                return ["Deleted"]
            return ["TagRemoved"] * (r.op == "remove_tag" and r.tag in asked[s.id]) + ["Exited"]
        if before and after:
            return {"add_tag": ["TagAdded"], "remove_tag": ["TagRemoved"]}.get(r.op, ["ContentChanged"] if r.op in ("set_attr", "remove_attr", "write_blob") else [])
        return []

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {"tags": {}, "removed": {}, "attrs": [], "rels": [], "gone": False, "n": 0, "lsn": None}
        rows = pd.concat(list(parts)).drop_duplicates("lsn").sort_values(["physical_ns", "logical", "node", "lsn"], kind="stable")
        if state["lsn"] is not None:
            rows = rows[rows["lsn"] > state["lsn"]]
        out, before = [], {s.id: member(s, state) for s in subs}
        for r in rows.itertuples():
            apply(r, state)
            for s in subs:
                after = member(s, state)
                for n, kind in enumerate(kinds(r, s, before[s.id], after) if s.sees_lsn(r.lsn) else ()):
                    if s.interest >> EVENTS.index(kind) & 1:
                        out.append((s.id, r.lsn, r.physical_ns, r.logical, r.node, key[0], r.tag if kind in ("TagAdded", "TagRemoved") else None, n, kind))
                before[s.id] = after
        if len(rows):
            state["lsn"] = int(rows["lsn"].max())
        held.update((json.dumps(state),))
        if watermark is not None and state["gone"]:
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, int(rows["physical_ns"].max()) // 10**6 if len(rows) else 0))
        yield pd.DataFrame(out, columns=names).astype({"logical": "int32", "node": "int32", "step": "int32"})

    timeout = GroupStateTimeout.NoTimeout
    if watermark is not None:
        ops = ops.withColumn("ts", F.timestamp_micros(F.expr("physical_ns div 1000"))).withWatermark("ts", watermark)
        timeout = GroupStateTimeout.EventTimeTimeout
    return ops.groupBy("oid").applyInPandasWithState(step, OUTPUT, "state string", "append", timeout)
