"""A machine agent over HTTP: endpoint, one-shot reads, and a replayable stream by sequence number."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from decimal import Decimal
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from . import xml

Fetch = Callable[[str], str]


class Endpoint:
    """An agent's base address; it must be an absolute http or https URL."""

    def __init__(self, base: str):
        parts = urlsplit(base or "")
        if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
            raise ValueError("E14: the endpoint must be an absolute http or https address")
        self.base = base if base.endswith("/") else f"{base}/"

    @property
    def probe(self) -> str:
        return f"{self.base}probe"

    @property
    def current(self) -> str:
        return f"{self.base}current"

    def sample(self, since: int) -> str:
        return f"{self.base}sample?from={since}"


def fetch(url: str) -> str:
    """The body of a GET; any status but 2xx raises (E15)."""
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read().decode()


def discover(endpoint: Endpoint, get: Fetch = fetch) -> dict:
    return xml.parse_probe(get(endpoint.probe))


def read_current(endpoint: Endpoint, machine_id: str, device_key: str, get: Fetch = fetch) -> list[dict]:
    return xml.parse_current(get(endpoint.current), machine_id, device_key)


def read_sample(endpoint: Endpoint, machine_id: str, device_key: str, since: int, get: Fetch = fetch) -> dict:
    return xml.parse_sample(get(endpoint.sample(since)), machine_id, device_key)


class InstanceChanged(RuntimeError):
    """The agent restarted: its sequence numbers start anew (E13)."""


def advance(cursor: dict, sample: dict) -> dict:
    """The cursor behind a sample; it follows the header's next sequence, whatever the observations hold."""
    if cursor.get("instance") not in (None, sample["instance_id"]):
        raise InstanceChanged(f"E13: agent instance {cursor['instance']} became {sample['instance_id']}")
    return {"instance": sample["instance_id"], "next": sample["next_sequence"]}


class Session:
    """A cursor held in memory: it moves when a read has succeeded and stays where it is otherwise."""

    def __init__(self, read: Callable[[int], dict], since: int):
        self._read = read
        self.cursor: dict = {"instance": None, "next": since}

    def next(self) -> dict:
        sample = self._read(self.cursor["next"])
        self.cursor = advance(self.cursor, sample)
        return sample


_COLUMNS = ("machine_id", "source", "address", "type", "value", "quality", "timestamp")
_VALUE = ("bool", "num", "text", "ts")


def _tuple(r: dict, *more: str) -> tuple:
    value = r["value"] and tuple(r["value"][k] for k in _VALUE)
    return (*(r[k] for k in more), *(value if c == "value" else r[c] for c in _COLUMNS))


class AgentSource(DataSource):
    """format("machine_agent"): options url, machine_id, device_key, mode (probe, current; sample for streams),
    from, and landing, a folder of the query's own that driver and executors share, where fetched samples are kept
    until a later one is committed.
    """

    @classmethod
    def name(cls) -> str:
        return "machine_agent"

    def schema(self) -> str:
        mode = self.options.get("mode", "sample")
        if mode == "probe":
            return xml.PROBE_ITEM
        return ("sequence decimal(20,0), " if mode == "sample" else "doc_ordinal int, ") + xml.OBSERVATION

    def reader(self, schema) -> DataSourceReader:
        return _AgentReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _AgentStream(dict(self.options))


class _AgentReader(DataSourceReader):
    """One request, so one partition."""

    def __init__(self, options: dict):
        self.options, self.endpoint = options, Endpoint(options.get("url", ""))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.options.get("mode") == "probe":
            yield from (tuple(r.values()) for r in xml.probe_rows(discover(self.endpoint)))
        else:
            for n, r in enumerate(read_current(self.endpoint, self.options["machine_id"], self.options["device_key"])):
                yield _tuple(r | {"doc_ordinal": n}, "doc_ordinal")


class _AgentStream(SimpleDataSourceStreamReader):
    """Offsets are cursors. A fetched document is landed before its rows are given out, so that a replay of
    the same offsets gives the same rows although the agent's buffer has moved on."""

    def __init__(self, options: dict):
        self.options, self.endpoint = options, Endpoint(options.get("url", ""))
        self.landing = options["landing"]
        os.makedirs(self.landing, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"instance": None, "next": int(self.options.get("from", "1"))}

    def _path(self, start: dict) -> str:
        return f"{self.landing}/{self._prefix()}-{start['instance']}-{start['next']:020d}.xml"

    def _prefix(self) -> str:
        return hashlib.sha256(self.endpoint.base.encode()).hexdigest()[:16]

    def _sample(self, body: str) -> dict:
        return xml.parse_sample(body, self.options["machine_id"], self.options["device_key"])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        path = self._path(start)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                body = f.read()
        else:
            body = fetch(self.endpoint.sample(start["next"]))
        sample = self._sample(body)
        end = advance(start, sample)
        if end["next"] == start["next"]:
            return iter([]), start
        if not os.path.exists(path):
            with open(f"{path}.part", "w", encoding="utf-8") as f:
                f.write(body)
            os.replace(f"{path}.part", path)
        return iter([_row(r) for r in sample["observations"]]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["next"] != end["next"] or start["instance"] != end["instance"]:
            with open(self._path(start), encoding="utf-8") as f:
                sample = self._sample(f.read())
            yield from (_row(r) for r in sample["observations"])
            start = advance(start, sample)

    def commit(self, end: dict) -> None:
        """Batches up to end are written: what was landed for them goes, and a replay begins at end."""
        for name in os.listdir(self.landing):
            if (m := re.fullmatch(rf"{self._prefix()}-\w+-(\d+)\.xml", name)) and int(m[1]) < end["next"]:
                os.remove(f"{self.landing}/{name}")


def _row(r: dict) -> tuple:
    return _tuple(r | {"sequence": Decimal(r["sequence"])}, "sequence")
