"""Operations, configuration, labels, reports and ratchet state from TOML and JSON files, checked as they are read."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import islice
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylens.runtime import shared_path

ENTRY = "ordinal int, fingerprint string, ci_id string, target_file string, line int"
SPACE = re.compile("[ \\t\\n\\r]*")
DECODER = json.JSONDecoder()
LABELS = ("true-positive", "false-positive", "skip")


@dataclass(frozen=True)
class Operations:
    """Accepted findings: baseline(ENTRY), waiver(ENTRY, waiver_id), suppression(ordinal, match)."""

    baseline: DataFrame
    waiver: DataFrame
    suppression: DataFrame


def _entries(payload: dict, table: str, required: str | None) -> list[dict]:
    found = payload.get(table, {})
    rows = found.get("entries", []) if isinstance(found, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"{table}.entries must be a list of tables")
    for r in rows:
        for k, v in r.items():
            if not isinstance(v, int if k == "line" else str) or isinstance(v, bool):
                raise ValueError(f"{table}: {k} has the wrong type")
        if required and not r.get(required):
            raise ValueError(f"{table}: {required} is missing")
    return rows


def operations_from(spark: SparkSession, payload: dict) -> Operations:
    place = lambda rows: [(k, r.get("fingerprint"), r.get("ci_id"), r.get("target_file"), r.get("line")) for k, r in enumerate(rows)]
    waivers = _entries(payload, "waiver", "waiver_id")
    return Operations(
        spark.createDataFrame(place(_entries(payload, "baseline", None)), ENTRY),
        spark.createDataFrame([(*p, r["waiver_id"]) for p, r in zip(place(waivers), waivers)], f"{ENTRY}, waiver_id string"),
        spark.createDataFrame([(k, r["match"]) for k, r in enumerate(_entries(payload, "suppression", "match"))], "ordinal int, match string"),
    )


def load_operations(spark: SparkSession, path: str | None) -> Operations:
    """Operations of a TOML file; none of any kind without one."""
    if not path:
        return operations_from(spark, {})
    with open(path, "rb") as f:
        return operations_from(spark, tomllib.load(f))


@dataclass(frozen=True)
class Config:
    profile: str = "quick-gate"
    scope_mode: str = "source-only"
    severity_threshold: str = "high"
    fail_on_new_findings: bool = False
    fail_on_unreviewed_review_required: bool = False
    fail_on_analyzer_errors: bool = False


def load_config(path: str) -> Config:
    with open(path, "rb") as f:
        payload = tomllib.load(f)
    kinds = {x.name: type(x.default) for x in fields(Config)}
    for k, v in payload.items():
        if k not in kinds or type(v) is not kinds[k]:
            raise ValueError(f"config: {k} is unknown or of the wrong type")
    if payload.get("severity_threshold", "high") not in ("low", "medium", "high", "critical"):
        raise ValueError("config: severity_threshold is no severity")
    return Config(**payload)


def config_schema() -> list[dict[str, str]]:
    return [{"key": x.name, "type": type(x.default).__name__, "default": str(x.default)} for x in fields(Config)]


def read_json(path: str) -> dict:
    """A report in UTF-8, with or without a mark, or UTF-16."""
    with open(path, "rb") as f:
        raw = f.read()
    for code in ("utf-8", "utf-8-sig", "utf-16"):
        try:
            return json.loads(raw.decode(code))
        except ValueError:
            continue
    raise ValueError(f"{path} is no JSON in a known encoding")


def ratchet_state(path: str) -> dict[str, int] | None:
    return {str(k): int(v) for k, v in read_json(path)["ci_id_counts"].items()} if os.path.isfile(path) else None


class _Json:
    """A JSON text that is read piece by piece: no more of it is held than the value at hand and a piece."""

    PIECE = 1 << 20

    def __init__(self, f: TextIO) -> None:
        self.f, self.text, self.at = f, "", 0

    def more(self) -> bool:
        """Read on; twice as far each time that a value doesn't end."""
        rest = self.text[self.at :]
        new = self.f.read(max(self.PIECE, len(rest)))
        self.text, self.at = rest + new, 0
        return bool(new)

    def peek(self) -> str:
        """The next sign that is no space, '' at the end."""
        while True:
            self.at = SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, signs: str) -> str:
        if not (c := self.peek()) or c not in signs:
            raise ValueError(f"{c or 'the end'} stands where one of {signs} is due")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                out, end = DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or not self.more():  # a number may go on in the next piece
                    self.at = end if end < len(self.text) else len(self.text)
                    return out
            except ValueError:
                if not self.more():
                    raise

    def items(self, closing: str) -> Iterator[None]:
        """Stop before each member of the array or object that is open, and after its closing sign."""
        if self.peek() == closing:
            self.at += 1
            return
        while True:
            yield
            if self.take(f",{closing}") == closing:
                return


def harness_items(path: str) -> Iterator[dict]:
    """The findings of a corpus document, one after another, in the encodings of read_json()."""
    with open(path, "rb") as f:
        head = f.read(4)
    code = "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-le" if b"\0" in head else "utf-8"
    missing = ValueError("the document has no list of findings; write it with them")
    with open(path, encoding=code, newline="") as f:
        j = _Json(f)
        if j.peek() != "{":
            raise missing
        j.take("{")
        seen = False
        for _ in j.items("}"):
            key = j.value()
            if not isinstance(key, str):
                raise ValueError("a key is no text")
            j.take(":")
            if key != "findings":
                j.value()
                continue
            if seen or j.peek() != "[":
                raise missing
            seen = True
            j.take("[")
            for _ in j.items("]"):
                if not isinstance(r := j.value(), dict):
                    raise missing
                yield r
        if j.peek():
            raise ValueError("the document goes on after its end")
        if not seen:
            raise missing


HARNESS = "fingerprint string, project string, ci_id string, signal string, target_file string, line int, emitted int"
HARNESS_ROWS = 20_000


def load_harness(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a corpus document (write_corpus), each with a fingerprint. The document is the driver's and is read piece by piece; the
    findings are written into the shared folder some thousands at a time."""
    names = "fingerprint project ci_id signal target_file".split()
    at, items, n = shared_path(spark), harness_items(path), 0
    while rows := list(islice(items, HARNESS_ROWS)):
        if not all(str(r.get("fingerprint") or "").strip() for r in rows):
            raise ValueError("a finding has no fingerprint")
        if not all(r.get("line") is None or type(r["line"]) is int for r in rows):
            raise ValueError("a finding's line is no number")
        columns = [pa.array([None if r.get(c) is None else str(r[c]) for r in rows], pa.string()) for c in names]
        columns += [pa.array([r.get("line") for r in rows], pa.int32()), pa.array(range(n, n + len(rows)), pa.int32())]
        spark.createDataFrame(pa.table(columns, [*names, "line", "emitted"])).coalesce(1).write.mode("append").parquet(at)
        n += len(rows)
    return spark.read.schema(HARNESS).parquet(at) if n else spark.createDataFrame([], HARNESS)


def load_labels(spark: SparkSession, path: str, allow_blank: bool = False) -> DataFrame:
    """labels(fingerprint, label, notes); each fingerprint once, each label a known one."""
    rows = read_json(path)
    seen = [r.get("fingerprint") for r in rows]
    if len(set(seen)) < len(seen) or not all(seen):
        raise ValueError("labels: a fingerprint is missing or comes twice")
    if any(r.get("label", "") not in (*LABELS, *[""] * allow_blank) for r in rows):
        raise ValueError("labels: unknown label")
    return spark.createDataFrame([(r["fingerprint"], r.get("label", ""), r.get("notes", "")) for r in rows], "fingerprint string, label string, notes string")
