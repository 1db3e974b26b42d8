"""Many machine agents as one source: a scan of a list of endpoints, and one stream of all their samples.

The list is dealt into groups by a hash of each agent; a group is a partition, so executors do all requests and
all parsing.  In a stream an offset is a tick and the cursor (instance, next sequence) from which that tick reads
each agent.  A task reads its group's agents from their cursors and lands what they said as one Parquet file of
rows, with the cursors behind them in the footer; the file appears whole or not at all, and the first
attempt's is the one that counts.  The driver reads footers to plan the next tick, and never speaks to an agent.
A replay of an offset finds the landed rows, although the agents' buffers have moved on; files go once a later
tick is committed.

An agent that fails (no answer, a bad document, a restart) ends the query in strict mode.  In quarantine mode it
gives one row of machine_id, agent, error_code and error, its cursor stays where it was, and the others go on.  An
agent that restarts has new sequence numbers: with on_restart=resume its reading goes on from the first
sequence of the new instance, and the restart itself is an E13 row in quarantine mode.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal
from http.client import HTTPException
from urllib.error import URLError

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.contract import MODES
from . import xml
from .agent import Endpoint, Fetch, InstanceChanged, advance, discover, fetch, read_current, read_sample

#: Groups that agents are dealt into.
GROUPS = 64
_ERRORS = "agent string, error_code string, error string"
SAMPLE = f"{_ERRORS}, position int, sequence decimal(20,0), {xml.OBSERVATION}"
CURRENT = f"{_ERRORS}, doc_ordinal int, {xml.OBSERVATION}"
PROBE = f"{_ERRORS}, machine_id string, {xml.PROBE_ITEM}"
_SCHEMAS = {"sample": SAMPLE, "current": CURRENT, "probe": PROBE}
_EXACT = Context(prec=60, rounding=ROUND_HALF_UP)
_NINTH = Decimal("1e-9")


@dataclass(frozen=True)
class Agent:
    """An endpoint and the machine it speaks for; since is the sequence that a stream begins at."""

    url: str
    machine_id: str
    device_key: str = ""
    since: int = 1

    @property
    def key(self) -> str:
        return f"{self.machine_id} {self.url}"


def agents_option(agents: list[Agent]) -> str:
    """The list as the option `agents`."""
    return json.dumps([[a.url, a.machine_id, a.device_key, a.since] for a in agents])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of dictionaries by schema; what they lack is null."""

    def exact(value: dict | None) -> dict | None:
        if not value or value["num"] is None:
            return value
        return value | {"num": _EXACT.quantize(value["num"], _NINTH)}

    columns = [pa.array([exact(r.get(f.name)) if f.name == "value" else r.get(f.name) for r in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def failure(error: Exception) -> tuple[str, str] | None:
    """(code, text) of what an agent or its document can do wrong; None of any other error."""
    if isinstance(error, xml.InvalidDocument):
        return error.code, str(error)
    if isinstance(error, InstanceChanged):
        return "E13", str(error)
    if isinstance(error, ValueError) and str(error).startswith("E14"):
        return "E14", str(error)
    if isinstance(error, (URLError, OSError, HTTPException, UnicodeDecodeError)):
        return "E15", f"E15: {error}"
    return None


def _guarded(agent: Agent, on_error: str, read: Callable[[], list[dict]]) -> list[dict]:
    """What read gives, or a row of its failure in quarantine mode."""
    named = {"agent": agent.url, "machine_id": agent.machine_id}
    try:
        return [named | r for r in read()]
    except Exception as e:
        if on_error == "strict" or (found := failure(e)) is None:
            raise
        return [named | {"error_code": found[0], "error": found[1]}]


class AgentsSource(DataSource):
    """format("machine_agents"): options agents (see agents_option), on_error (strict, quarantine), groups; mode
    (probe, current) for a scan; on_restart (stay, resume) and landing, a folder of the query's own that driver
    and executors share and that can link files, for a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "machine_agents"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("mode", "sample")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _AgentsReader(_settings(self.options, schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _AgentsStream(_settings(self.options, schema))


@dataclass
class _Settings:
    agents: list[Agent]
    on_error: str
    on_restart: str
    mode: str
    groups: int
    landing: str
    schema: pa.Schema

    def dealt(self) -> dict[int, list[Agent]]:
        found: dict[int, list[Agent]] = {}
        for a in self.agents:
            found.setdefault(zlib.crc32(a.key.encode()) % self.groups, []).append(a)
        return found


def _settings(options: dict, schema: T.StructType) -> _Settings:
    agents = [Agent(*a) for a in json.loads(options["agents"])]
    s = _Settings(
        agents, options.get("on_error", "strict"), options.get("on_restart", "stay"), options.get("mode", "sample"),
        int(options.get("groups", GROUPS)), options.get("landing", ""), to_arrow_schema(schema),
    )
    if s.on_error not in MODES or s.on_restart not in ("stay", "resume"):
        raise ValueError(f"on_error must be one of {MODES}, on_restart stay or resume")
    if len({a.key for a in agents}) < len(agents):
        raise ValueError("an agent is listed twice for one machine")
    if s.on_error == "strict":
        for a in agents:
            Endpoint(a.url)
    return s


class _Group(InputPartition):
    def __init__(self, number: int, agents: list[Agent], tick: int = 0, since: dict | None = None):
        self.number, self.agents, self.tick, self.since = number, agents, tick, since or {}


class _AgentsReader(DataSourceReader):
    def __init__(self, settings: _Settings, get: Fetch = fetch):
        self.settings, self.get = settings, get

    def partitions(self) -> list[InputPartition]:
        return [_Group(n, agents) for n, agents in sorted(self.settings.dealt().items())]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        for a in partition.agents:
            rows = _guarded(a, self.settings.on_error, lambda a=a: self._rows(a))
            if rows:
                yield _batch(rows, self.settings.schema)

    def _rows(self, a: Agent) -> list[dict]:
        if self.settings.mode == "probe":
            return xml.probe_rows(discover(Endpoint(a.url), self.get))
        found = read_current(Endpoint(a.url), a.machine_id, a.device_key, self.get)
        return [{"doc_ordinal": n} | r for n, r in enumerate(found)]


def read_on(agent: Agent, cursor: dict, resume: bool, get: Fetch = fetch) -> tuple[list[dict], dict, str | None]:
    """An agent's next rows, the cursor behind them, and the text of a restart that was followed."""
    endpoint, restarted = Endpoint(agent.url), None
    sample = read_sample(endpoint, agent.machine_id, agent.device_key, cursor["next"], get)
    try:
        behind = advance(cursor, sample)
    except InstanceChanged as e:
        if not resume:
            raise
        restarted = str(e)
        sample = read_sample(endpoint, agent.machine_id, agent.device_key, sample["first_sequence"], get)
        behind = advance({}, sample)
    rows = [{"position": n} | r | {"sequence": Decimal(r["sequence"])} for n, r in enumerate(sample["observations"])]
    return rows, behind, restarted


class _AgentsStream(DataSourceStreamReader):
    def __init__(self, settings: _Settings, get: Fetch = fetch):
        self.settings, self.get = settings, get
        if not settings.landing:
            raise ValueError("a stream of agents needs a landing folder")
        os.makedirs(settings.landing, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"tick": 0, "since": {}}

    def latestOffset(self) -> dict:
        """The next tick: every agent from where the last file of its group left it."""
        since = {a.key: {"instance": None, "next": a.since} for a in self.settings.agents}
        newest: dict[int, int] = {}
        for number, tick in self._landed():
            newest[number] = max(tick, newest.get(number, 0))
        for number, tick in newest.items():
            footer = pq.read_metadata(self._path(number, tick)).metadata
            since |= {k: c for k, c in json.loads(footer[b"cursors"]).items() if k in since}
        return {"tick": max(newest.values(), default=0) + 1, "since": since}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Group(n, agents, end["tick"], {a.key: end["since"][a.key] for a in agents}) for n, agents in sorted(self.settings.dealt().items())]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        path = self._path(partition.number, partition.tick)
        if not os.path.exists(path):
            self._land(partition, path)
        with pq.ParquetFile(path) as landed:
            yield from landed.iter_batches()

    def _land(self, partition: _Group, path: str) -> None:
        """Reads the group's agents into a file of this attempt's own, and links it in unless another one's is there."""
        own, cursors = f"{path}.{uuid.uuid4().hex}", dict(partition.since)
        try:
            with pq.ParquetWriter(own, self.settings.schema) as out:
                for a in partition.agents:
                    rows = _guarded(a, self.settings.on_error, lambda a=a: self._next(a, cursors))
                    if rows:
                        out.write_batch(_batch(rows, self.settings.schema))
                out.add_key_value_metadata({"cursors": json.dumps(cursors)})
            with suppress(FileExistsError):
                os.link(own, path)
        finally:
            with suppress(FileNotFoundError):
                os.remove(own)

    def _next(self, agent: Agent, cursors: dict) -> list[dict]:
        rows, behind, restarted = read_on(agent, cursors[agent.key], self.settings.on_restart == "resume", self.get)
        moved = behind != cursors[agent.key]
        cursors[agent.key] = behind
        marker = [{"error_code": "E13", "error": restarted}] if restarted and self.settings.on_error == "quarantine" else []
        return [*marker, *(rows if moved else [])]

    def commit(self, end: dict) -> None:
        """The files of the tick that was committed stay, for their cursors."""
        for number, tick in self._landed():
            if tick < end["tick"]:
                os.remove(self._path(number, tick))

    def _path(self, number: int, tick: int) -> str:
        return f"{self.settings.landing}/{number:05d}-{tick:020d}.parquet"

    def _landed(self) -> list[tuple[int, int]]:
        names = map(re.compile(r"(\d+)-(\d+)\.parquet").fullmatch, os.listdir(self.settings.landing))
        return [(int(m[1]), int(m[2])) for m in names if m]
