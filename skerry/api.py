"""The verbs of the search service as calls: method, path and body in, status and JSON out. There is no server."""

from __future__ import annotations

from typing import Any
from urllib.parse import parse_qs, urlsplit

from .plans import dsl
from .plans.errors import InvalidRequest, NotFound, SearchError
from .sources.store import Index, Settings, Store

_SETTINGS = ("mapping_mode", "primary_time_field", "namespace", "retention_secs", "merge_threshold_docs")


class Api:
    """Routes over a store. Indexes stay open between calls, so their statistics are kept."""

    def __init__(self, store: Store):
        self.store, self.open = store, {}

    def request(self, method: str, path: str, body: Any = None) -> tuple[int, Any]:
        """(status, response); an error of the request is a response with its status."""
        parts = urlsplit(path)
        try:
            return self._route(method.upper(), [p for p in parts.path.split("/") if p], parse_qs(parts.query), body)
        except SearchError as e:
            return e.status, {"error": {"type": type(e).__name__, "reason": str(e)}, "status": e.status}

    def _index(self, name: str) -> Index:
        self.store.get_index(name)
        if name not in self.open:
            self.open[name] = self.store.open(name)
        return self.open[name]

    def _route(self, method: str, path: list[str], query: dict, body: Any) -> tuple[int, Any]:
        if path == ["_health"] and method == "GET":
            return 200, {"status": "ok"}
        if path == ["metrics"] and method == "GET":
            return 200, self.metrics()
        if path == ["_msearch"] and method == "POST":
            return 200, {"responses": [self._one_of_many(x) for x in (body or {}).get("requests", [])]}
        if len(path) == 1:
            return self._lifecycle(method, path[0], body or {})
        if len(path) < 2:
            raise NotFound("/" + "/".join(path))
        index = self._index(path[0])
        rest, write = path[1:], method in ("PUT", "POST")
        if rest == ["_settings"] and method == "PUT":
            return 200, self.store.update_settings(index.name, (body or {}).get("retention_secs"))
        if rest == ["_doc"] and write:
            _need(isinstance(body, dict) and isinstance(body.get("id"), str) and "source" in body, "a document needs id and source")
            out = index.index_document(body["id"], body["source"])
            return (201 if out["result"] == "created" else 200), out
        if len(rest) == 2 and rest[0] == "_doc" and method == "GET":
            source = index.get_document(rest[1])
            return (404, {"_id": rest[1], "found": False}) if source is None else (200, {"_id": rest[1], "found": True, "_source": source})
        if rest == ["_bulk"] and write:
            _need(isinstance(body, dict) and isinstance(body.get("operations"), list), "a bulk needs a list of operations")
            return 200, index.bulk(body["operations"])
        if rest == ["_refresh"] and write:
            return 200, {"refreshed_operations": index.refresh()}
        if rest == ["_flush"] and write:
            return 200, index.flush()
        if rest == ["_merge"] and method == "POST":
            return 200, index.merge()
        if rest == ["_search"] and write:
            return 200, index.search(body or {})
        if rest == ["_search"] and method == "GET":
            _need(query.get("q"), "a search by GET needs q")
            return 200, index.search_string(query["q"][0])
        if rest == ["_suggest"] and method == "POST":
            _need(isinstance(body, dict) and isinstance(body.get("prefix"), str) and isinstance(body.get("fields"), dict), "a suggestion needs prefix and fields")
            return 200, {"suggestions": index.suggest(body["prefix"], body["fields"], body.get("size", 10))}
        if rest[0] == "_snapshot":
            return self._snapshots(method, index, rest[1:])
        raise NotFound(f"{method} /" + "/".join(path))

    def _lifecycle(self, method: str, name: str, body: dict) -> tuple[int, Any]:
        if method == "PUT":
            settings = body.get("settings") or {}
            _need(set(settings) <= set(_SETTINGS), "unknown settings")
            return 201, self.store.create_index(name, Settings(**settings), body.get("mappings"))
        if method == "GET":
            return 200, self.store.get_index(name)
        if method == "DELETE":
            self.store.delete_index(name)
            self.open.pop(name, None)
            return 200, {"acknowledged": True}
        raise NotFound(f"{method} /{name}")

    @staticmethod
    def _snapshots(method: str, index: Index, rest: list[str]) -> tuple[int, Any]:
        if not rest and method == "GET":
            return 200, {"snapshots": index.snapshots()}
        if len(rest) == 1 and method == "POST":
            return 201, index.create_snapshot(rest[0])
        if len(rest) == 1 and method == "GET":
            return 200, index.get_snapshot(rest[0])
        if len(rest) == 1 and method == "DELETE":
            index.delete_snapshot(rest[0])
            return 200, {"acknowledged": True}
        if len(rest) == 2 and rest[1] == "_restore" and method == "POST":
            return 200, index.restore_snapshot(rest[0])
        raise NotFound("snapshot")

    def _one_of_many(self, item: Any) -> dict:
        """One of several searches: its own status, and the hits flat."""
        try:
            _need(isinstance(item, dict) and isinstance(item.get("index"), str), "a search needs an index")
            body = item.get("request", item.get("body")) or {}
            dsl.request(body)
            found = self._index(item["index"]).search(body)
            hits = [{"id": h["_id"], "score": h["_score"], "source": h["_source"]} | ({"sort_values": h["sort"]} if "sort" in h else {}) for h in found["hits"]["hits"]]
            return {"status": 200, "hits": {"total": found["hits"]["total"]["value"], "hits": hits}} | ({"aggregations": found["aggregations"]} if "aggregations" in found else {})
        except SearchError as e:
            return {"status": e.status, "error": str(e)}

    def metrics(self) -> str:
        """Counters and gauges in the text form that scrapers read."""
        lines = [f"skerry_indexes {len(self.store.indexes())}"]
        for name in self.store.indexes():
            lines += [f'skerry_{k}{{index="{name}"}} {v}' for k, v in sorted(self._index(name).metrics().items())]
        return "\n".join(lines) + "\n"


def _need(ok: Any, why: str) -> None:
    if not ok:
        raise InvalidRequest(why)
