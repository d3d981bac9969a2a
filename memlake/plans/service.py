"""The tool surface: every tool is a DataFrame plan; JSON appears only at the edge."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import graph as G
from memlake.operators import layers
from memlake.operators import store as S
from memlake.runtime import checkpointed, written


class Service:
    """Tools over a drawer snapshot and, optionally, entities and facts; changes replace the snapshot.

    Results leave a tool as JSON text with the count of all rows. One of more than ``MAX_ROWS`` rows is written to
    a table and leaves in pages of that many: each but the last has a ``next`` key, and a call of the same tool with
    it as argument ``next`` gives the page that follows. Pages are of one snapshot, whatever changes between them.
    """

    MAX_ROWS = 1000

    def __init__(self, spark: SparkSession, drawers: DataFrame, entities: DataFrame | None = None, triples: DataFrame | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.drawers, self.entities, self.triples, self.clock = spark, drawers, entities, triples, clock
        self._open: dict[str, tuple[str, DataFrame, int]] = {}

    def tools(self) -> list[str]:
        base = ["status", "search", "list_wings", "list_rooms", "add_drawer", "delete_drawer"]
        return base + ["kg_query", "kg_add", "traverse_graph"] * (self.entities is not None)

    def call(self, name: str, args: dict) -> DataFrame:
        """The result of a tool; an unknown tool or a missing argument is an error."""
        tool = getattr(self, f"_{name}", None)
        if tool is None:
            raise KeyError(f"unknown tool: {name}")
        return tool(args)

    @staticmethod
    def _need(args: dict, *names: str) -> list:
        missing = [n for n in names if not args.get(n)]
        if missing:
            raise ValueError(f"missing argument: {', '.join(missing)}")
        return [args[n] for n in names]

    def _status(self, args):
        out = G.palace_stats(self.drawers)
        if self.entities is not None:
            out = out.crossJoin(G.fact_stats(self.entities, self.triples).select(F.col("entities").alias("kg_entities"), F.col("triples").alias("kg_triples")))
        return out

    def _search(self, args):
        (query,) = self._need(args, "query")
        return layers.search(self.drawers, query, int(args.get("limit") or 10), args.get("wing") or "", args.get("room") or "").drop("shown", "position")

    def _list_wings(self, args):
        return self.drawers.groupBy(F.col("wing").alias("name")).agg(F.count("*").alias("drawers")).orderBy("name")

    def _list_rooms(self, args):
        (wing,) = self._need(args, "wing")
        return self.drawers.where(F.col("wing") == wing).groupBy(F.col("room").alias("name")).agg(F.count("*").alias("drawers")).orderBy("name")

    def _add_drawer(self, args):
        id_, document, wing, room = self._need(args, "id", "document", "wing", "room")
        if not self.drawers.where(F.col("id") == id_).isEmpty():
            raise ValueError(f"drawer exists: {id_}")
        top = self.drawers.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        row = (int(top), id_, document, wing, room, args.get("source") or "", self.clock().strftime("%Y-%m-%dT%H:%M:%SZ"), "")
        self.drawers = checkpointed(S.insert(self.drawers, self.spark.createDataFrame([row], "seq long, id string, document string, wing string, room string, source string, filed_at string, hall string")))  # a change of a long-lived snapshot cuts its lineage
        return self.spark.createDataFrame([("ok", id_)], "status string, id string")

    def _delete_drawer(self, args):
        (id_,) = self._need(args, "id")
        self.drawers = checkpointed(S.delete(self.drawers, self.spark.createDataFrame([(id_,)], "id string")))
        return self.spark.createDataFrame([("ok", id_)], "status string, id string")

    def _kg_query(self, args):
        (subject,) = self._need(args, "subject")
        return G.active_facts(self.entities, self.triples, subject).select("subject", "predicate", "object", "valid_from").orderBy("predicate", "object", "valid_from")

    def _kg_add(self, args):
        subject, predicate, object_ = self._need(args, "subject", "predicate", "object")
        day = self.clock().strftime("%Y-%m-%d")
        self.entities = checkpointed(S.add_entities(self.entities, self.spark.createDataFrame([(subject,)], "name string")))
        fact = self.entities.where(F.col("name") == subject).select(F.col("id").alias("subject_id"), F.lit(predicate).alias("predicate"), F.lit(object_).alias("object"), F.lit(day).alias("valid_from"), F.lit("").alias("valid_to"))
        top = self.triples.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        self.triples = checkpointed(self.triples.unionByName(fact.withColumn("id", F.lit(int(top))), allowMissingColumns=True))
        return self.spark.createDataFrame([(subject, predicate, object_, day)], "subject string, predicate string, object string, valid_from string")

    def _traverse_graph(self, args):
        (start,) = self._need(args, "start_room")
        return G.traverse(self.drawers, start, int(args.get("max_hops") or 2)).select("id", "document", "wing", "room").orderBy("id", "wing", "room")

    def _page(self, name: str, args: dict) -> dict:
        """A tool's rows, or the page of them that ``next`` names, with the count of all."""
        if args.get("next"):
            key, _, after = str(args["next"]).partition(":")
            if key not in self._open or self._open[key][0] != name or not after.lstrip("-").isdigit():
                raise ValueError(f"unknown page: {args['next']}")
            return self._cut(key, int(after))
        result = self.call(name, args)
        rows = [json.loads(r) for r in result.limit(self.MAX_ROWS + 1).toJSON().collect()]
        if len(rows) <= self.MAX_ROWS:
            return {"rows": rows, "count": len(rows)}
        table, key = written(result.withColumn("_at", F.monotonically_increasing_id())), uuid.uuid4().hex
        self._open[key] = (name, table, table.count())
        return self._cut(key, -1)

    def _cut(self, key: str, after: int) -> dict:
        _, table, count = self._open[key]
        rows = [json.loads(r) for r in table.where(F.col("_at") > after).orderBy("_at").limit(self.MAX_ROWS + 1).toJSON().collect()]
        at = [r.pop("_at") for r in rows]
        page = {"rows": rows[: self.MAX_ROWS], "count": count}
        return page | {"next": f"{key}:{at[self.MAX_ROWS - 1]}"} if len(rows) > self.MAX_ROWS else page

    def handle(self, line: str) -> str | None:
        """One JSON-RPC 2.0 request to its response; notifications have none."""
        try:
            request = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}})
        method, params = request.get("method"), request.get("params") or {}
        reply = lambda **x: json.dumps({"jsonrpc": "2.0", "id": request.get("id"), **x})
        if method == "initialize":
            return reply(result={"protocolVersion": "2024-11-05", "serverInfo": {"name": "memlake", "version": "1"}, "capabilities": {"tools": {}}})
        if method == "notifications/initialized":
            return None
        if method == "tools/list":
            return reply(result={"tools": [{"name": n} for n in self.tools()]})
        if method != "tools/call":
            return reply(error={"code": -32601, "message": f"Method not found: {method}"})
        try:
            page = self._page(params.get("name"), params.get("arguments") or {})
            return reply(result={"content": [{"type": "text", "text": json.dumps(page)}]})
        except (KeyError, ValueError) as e:
            return reply(result={"content": [{"type": "text", "text": str(e)}], "isError": True})
