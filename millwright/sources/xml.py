"""Agent documents (device probe, current values, samples) as rows.

Spark partitions the payloads; each is one string that a small parser turns into rows. Element and
attribute names are compared without their namespaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES, U64_MAX_TEXT, VALUE
from ..shared import light_batches


class InvalidDocument(ValueError):
    """A document that breaks the protocol; code as in the error contract."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _name(element: ElementTree.Element) -> str:
    return _local(element.tag) if isinstance(element.tag, str) else ""


def _of(attributes: dict[str, str], name: str) -> str | None:
    return next((v for k, v in attributes.items() if _local(k) == name), None)


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return _of(element.attrib, name)


def _root(xml: str | None) -> ElementTree.Element:
    if xml is None or not xml.strip():
        raise InvalidDocument("E16", "the document is blank")
    try:
        return ElementTree.fromstring(xml.encode())
    except ElementTree.ParseError as e:
        raise InvalidDocument("E15", f"malformed document: {e}") from e


def _required(element: ElementTree.Element, name: str) -> str:
    if (value := _attribute(element, name)) is None:
        raise InvalidDocument("E12", f"{_name(element)} has no {name}")
    return value


def parse_probe(xml: str | None) -> dict:
    """agent_instance_id, agent_version and devices with all their data items."""
    root = _root(xml)
    header = next((e for e in root.iter() if _name(e) == "Header"), None)
    above = {child: e for e in root.iter() for child in e}

    def item(e: ElementTree.Element) -> dict:
        holder = above.get(above.get(e))
        component = holder if holder is not None and _name(holder) != "Device" else None
        of = (lambda n: _attribute(component, n)) if component is not None else (lambda n: None)
        found = {"id": _required(e, "id"), "type": _required(e, "type")}
        optional = {k: _attribute(e, a) for k, a in (("name", "name"), ("category", "category"), ("sub_type", "subType"), ("units", "units"))}
        return found | optional | {"component_id": of("id"), "component_name": of("name"), "component_type": None if component is None else _name(component)}

    def device(e: ElementTree.Element) -> dict:
        return {"id": _required(e, "id"), "name": _attribute(e, "name"), "uuid": _attribute(e, "uuid"), "data_items": [item(x) for x in e.iter() if _name(x) == "DataItem"]}

    return {
        "agent_instance_id": None if header is None else _attribute(header, "instanceId"),
        "agent_version": None if header is None else _attribute(header, "version"),
        "devices": [device(e) for e in root.iter() if _name(e) == "Device"],
    }


_SECTIONS = {"Samples": "Numeric", "Events": "Enumeration", "Condition": "Text"}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
_LARGEST = Decimal("79228162514264337593543950335")


def _instant(text: str | None) -> datetime:
    try:
        at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.strip()))
    except (AttributeError, ValueError) as e:
        raise InvalidDocument("E11", f"{text!r} is no timestamp") from e
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


def _observation(attributes: dict[str, str], text: str, kind: str | None, machine_id: str) -> dict:
    item = _of(attributes, "dataItemId") or ""
    if not item.strip():
        raise InvalidDocument("E11", "dataItemId is blank")
    at = _instant(_of(attributes, "timestamp"))
    if kind is None:
        raise InvalidDocument("E11", f"{item} stands outside Samples, Events and Condition")
    text = text.strip()
    value, quality = {"bool": None, "num": None, "text": None, "ts": None}, "Good"
    if text.lower() == "unavailable":
        value, quality = None, "Uncertain"
    elif kind == "Numeric":
        try:
            number = Decimal(text) if _NUMBER.fullmatch(text) else None
        except InvalidOperation:
            number = None
        if number is None or number.copy_abs() > _LARGEST:
            raise InvalidDocument("E11", f"{item} is a sample without a number: {text!r}")
        value["num"] = number
    else:
        value["text"] = text
    return {"machine_id": machine_id, "source": "mtconnect", "address": item, "type": kind, "value": value, "quality": quality, "timestamp": at}


def _u64(name: str, attributes: dict[str, str], key: str) -> int:
    text = _of(attributes, key) or ""
    if not re.fullmatch("[0-9]+", text) or int(text) > int(U64_MAX_TEXT):
        raise InvalidDocument("E9", f"{name} has no valid {key}")
    return int(text)


@dataclass
class _Reading:
    ordinal: int
    name: str
    attributes: dict[str, str]
    kind: str | None
    text: list[str] = field(default_factory=list)


class DocumentReader:
    """One device's readings of a document that is read piece by piece, in memory for the open elements alone.

    rows gives each reading when its element ends, with its place in the document (doc_ordinal) and, of a sample, its
    sequence.  What is wrong with the document is known at its end: rows raises then, the blank document before the
    blank key, malformed text before all that the document says, the header before the device, and of the
    readings the first one.  Until then what was given out is not to be used; check reads a document for that alone.
    """

    def __init__(self, machine_id: str, device_key: str, sample: bool):
        self.machine_id, self.device_key, self.sample = machine_id, device_key, sample
        self.headers: list[dict[str, str]] = []
        self._key = (device_key or "").lower()
        self._open: list[tuple[str | None, _Reading | None]] = []  # what each open element sets for those in it, and its reading
        self._texts: list[_Reading] = []
        self._device: int | None = None  # depth of the device's element while it is open
        self._matches = self._count = 0
        self._failed: tuple[int, InvalidDocument] | None = None
        self._done: list[dict] = []
        self._parser = expat.ParserCreate(namespace_separator="}")
        self._parser.buffer_text = True
        self._parser.StartElementHandler, self._parser.EndElementHandler, self._parser.CharacterDataHandler = self._start, self._end, self._said

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        name = _local(tag)
        if name == "Header":
            self.headers.append(attributes)
        kind = self._open[-1][0] if self._open else None
        reading = None
        if self._device is not None and _of(attributes, "dataItemId") is not None:
            reading = _Reading(self._count, name, attributes, kind)
            self._count += 1
            self._texts.append(reading)
        if name == "DeviceStream" and any((_of(attributes, a) or "").lower() == self._key for a in ("name", "uuid")):
            self._matches += 1
            if self._matches == 1:
                self._device, kind = len(self._open), None
        inside = self._device is not None and self._device < len(self._open)
        self._open.append((_SECTIONS.get(name, kind) if inside else None, reading))

    def _said(self, text: str) -> None:
        for r in self._texts:
            r.text.append(text)

    def _end(self, tag: str) -> None:
        _, reading = self._open.pop()
        if self._device == len(self._open):
            self._device = None
        if reading is None:
            return
        self._texts.pop()
        try:
            row = {"sequence": _u64(reading.name, reading.attributes, "sequence")} if self.sample else {}
            self._done.append({"doc_ordinal": reading.ordinal} | row | _observation(reading.attributes, "".join(reading.text), reading.kind, self.machine_id))
        except InvalidDocument as e:
            if self._failed is None or reading.ordinal < self._failed[0]:
                self._failed = reading.ordinal, e

    def rows(self, pieces: Iterable[bytes]) -> Iterator[dict]:
        blank = True
        try:
            for piece in pieces:
                if blank and piece.strip():
                    blank = False
                    if not self._key.strip():
                        raise InvalidDocument("E16", "a device key is required")
                self._parser.Parse(piece, False)
                done, self._done = self._done, []
                yield from done
            if blank:
                raise InvalidDocument("E16", "the document is blank")
            self._parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise InvalidDocument("E15", f"malformed document: {e}") from e
        self.header()
        if self._matches > 1:
            raise InvalidDocument("E10", f"several device streams match {self.device_key}")
        if self._failed:
            raise self._failed[1]

    def header(self) -> dict:
        """A sample's sequences; its one header has to be sound."""
        if not self.sample:
            return {}
        if len(self.headers) != 1:
            raise InvalidDocument("E9", f"{len(self.headers)} headers")
        names = (("instance_id", "instanceId"), ("first_sequence", "firstSequence"), ("last_sequence", "lastSequence"), ("next_sequence", "nextSequence"))
        return {k: _u64("Header", self.headers[0], a) for k, a in names}


#: Bytes of a document that are parsed at a time.
PIECE = 1 << 20


def _pieces(xml: str | None) -> Iterator[bytes]:
    for i in range(0, len(xml or ""), PIECE):
        yield xml[i : i + PIECE].encode()


def parse_current(xml: str | None, machine_id: str, device_key: str) -> list[dict]:
    """Observations of one device in document order; none if the device isn't there."""
    rows = sorted(DocumentReader(machine_id, device_key, False).rows(_pieces(xml)), key=lambda r: r["doc_ordinal"])
    return [{k: v for k, v in r.items() if k != "doc_ordinal"} for r in rows]


def parse_sample(xml: str | None, machine_id: str, device_key: str) -> dict:
    """The header's sequences and one device's observations by sequence, ties in document order."""
    reader = DocumentReader(machine_id, device_key, True)
    rows = sorted(reader.rows(_pieces(xml)), key=lambda r: (r["sequence"], r["doc_ordinal"]))
    return reader.header() | {"observations": [{k: v for k, v in r.items() if k != "doc_ordinal"} for r in rows]}


OBSERVATION = f"machine_id string, source string, address string, type string, value {VALUE}, quality string, timestamp timestamp"


#: Rows that are given to Spark at a time.
ROWS = 10_000


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


def _each(payloads: DataFrame, parse: Callable[[dict], list[dict]], schema: str, on_error: str) -> DataFrame:
    """Rows of each payload; in quarantine mode a bad document is a row of error alone.

    A worker holds an Arrow batch of payloads, the rows of one of them, and ROWS more.
    """
    names = ["payload_id", "error", *T.StructType.fromDDL(schema).names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for frame in frames:
            for payload in frame.to_dict("records"):
                try:
                    out += [{"payload_id": payload["payload_id"], "error": None} | r for r in parse(payload)]
                except InvalidDocument as e:
                    if on_error == "strict":
                        raise
                    out.append({"payload_id": payload["payload_id"], "error": str(e)})
                while len(out) >= ROWS:
                    yield _frame(out[:ROWS], names)
                    del out[:ROWS]
        yield _frame(out, names)

    return light_batches(payloads).mapInPandas(run, f"payload_id bigint, error string, {schema}")


_ITEM = ("id", "name", "type", "category", "sub_type", "units", "component_id", "component_name", "component_type")
PROBE_ITEM = "agent_instance_id string, agent_version string, device_id string, device_name string, device_uuid string, doc_ordinal int, " + ", ".join(f"item_{k} string" for k in _ITEM)


def probe_rows(found: dict) -> list[dict]:
    """A parsed probe as one row for each data item, in the order of PROBE_ITEM."""
    head = {k: found[k] for k in ("agent_instance_id", "agent_version")}
    return [
        head | {"device_id": d["id"], "device_name": d["name"], "device_uuid": d["uuid"], "doc_ordinal": n} | {f"item_{k}": i[k] for k in _ITEM}
        for d in found["devices"]
        for n, i in enumerate(d["data_items"])
    ]


def probe_items(payloads: DataFrame, on_error: str = "strict") -> DataFrame:
    """payloads (payload_id, xml) to one row for each data item."""
    return _each(payloads, lambda p: probe_rows(parse_probe(p["xml"])), PROBE_ITEM, on_error)


def current_rows(payloads: DataFrame, on_error: str = "strict") -> DataFrame:
    """payloads (payload_id, xml, machine_id, device_key) to observations with their place in the document."""
    return _each(payloads, lambda p: [{"doc_ordinal": n} | r for n, r in enumerate(parse_current(p["xml"], p["machine_id"], p["device_key"]))], f"doc_ordinal int, {OBSERVATION}", on_error)


def sample_rows(payloads: DataFrame, on_error: str = "strict") -> DataFrame:
    """payloads (payload_id, xml, machine_id, device_key) to observations with sequence, in order of sequence."""

    def parse(p: dict) -> list[dict]:
        return [{"position": n} | r | {"sequence": Decimal(r["sequence"])} for n, r in enumerate(parse_sample(p["xml"], p["machine_id"], p["device_key"])["observations"])]

    return _each(payloads, parse, f"position int, sequence decimal(20,0), {OBSERVATION}", on_error)


def sample_envelopes(payloads: DataFrame, on_error: str = "strict") -> DataFrame:
    """payloads to one row each: the header's sequences."""

    def parse(p: dict) -> list[dict]:
        found = parse_sample(p["xml"], p["machine_id"], p["device_key"])
        return [{k: Decimal(found[k]) for k in ("instance_id", "first_sequence", "last_sequence", "next_sequence")}]

    return _each(payloads, parse, TABLES["sample_envelopes"], on_error)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _file(path: str) -> Iterator[bytes]:
    """A file of any store that pyarrow opens, in pieces."""
    store, name = store_of(path)
    with store.open_input_stream(name) as f:
        while piece := f.read(PIECE):
            yield piece


def _of_files(files: DataFrame, sample: bool, on_error: str) -> DataFrame:
    sequence = "sequence decimal(20,0), " if sample else ""
    schema = f"payload_id bigint, error string, doc_ordinal bigint, {sequence}{OBSERVATION}"
    names = T.StructType.fromDDL(schema).names

    def rows(payload: dict) -> Iterator[dict]:
        own = lambda: DocumentReader(payload["machine_id"], payload["device_key"], sample).rows(_file(payload["path"]))
        try:
            for _ in own():  # all of it has to be sound before any of it is given out
                pass
        except InvalidDocument as e:
            if on_error == "strict":
                raise
            yield {"error": str(e)}
            return
        yield from own()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for payload in frame.to_dict("records"):
                found = rows(payload)
                while some := list(islice(found, ROWS)):
                    out = [{"payload_id": payload["payload_id"]} | r | ({"sequence": Decimal(r["sequence"])} if "sequence" in r else {}) for r in some]
                    yield _frame(out, names)

    return files.select("payload_id", "path", "machine_id", "device_key").mapInPandas(run, schema)


def current_files(files: DataFrame, on_error: str = "strict") -> DataFrame:
    """files (payload_id, path, machine_id, device_key) to observations with their place in the document.

    Documents may be of any size and depth: each is read twice, piece by piece, first to see that it is sound.
    """
    return _of_files(files, False, on_error)


def sample_files(files: DataFrame, on_error: str = "strict") -> DataFrame:
    """The same of samples, with sequence, and position in the order of (sequence, place in the document)."""
    arrival = Window.partitionBy("payload_id").orderBy("sequence", "doc_ordinal")
    position = F.when(F.col("error").isNull(), F.row_number().over(arrival) - 1)
    return _of_files(files, True, on_error).withColumn("position", position)
