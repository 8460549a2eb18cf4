"""A store of fitted states and results by the address of what they were computed from.

A value is written once, as Parquet tables below a folder that driver and executors share, and read by whoever asks for the same
address later, in this session or another.  The manifest is written last, so a half-written value is never found.
"""

from __future__ import annotations

import atexit
import base64
import contextlib
import dataclasses
import importlib
import io
import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "manifest.json"


class NotStorable(TypeError):
    """A value that holds something other than tables, arrays, dataclasses and plain data."""


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.quillmat.store.dir, else one below spark.checkpoint.dir; only a local session that sets neither gets a temporary one."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.quillmat.store.dir", None):
        return root.rstrip("/")
    if root := conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return f"{root.rstrip('/')}/quillmat-store"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir or spark.quillmat.store.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="quillmat-store-")


class Store:
    """Values below ``root``.  ``hits`` and ``writes`` count what this object found and wrote."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_root(spark)).rstrip("/")
        self.hits = self.writes = 0

    # --- files, in any file system that Spark reaches

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _delete(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.delete(path, True)

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        path, fs = self._path(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def folder(self, address: str) -> str:
        return f"{self.root}/{address[:2]}/{address}"

    # --- values

    def _encoded(self, value: Any, folder: str, seen: dict[int, dict]) -> Any:
        if value is None or isinstance(value, bool | int | str):
            return value
        if isinstance(value, float):
            return {"float": value.hex() if value == value else "nan"}
        if isinstance(value, DataFrame):
            if id(value) not in seen:  # one table that stands in several places stays one
                seen[id(value)] = {"table": len(seen), "schema": value.schema.json()}
                value.write.parquet(f"{folder}/table-{seen[id(value)]['table']}")
            return seen[id(value)]
        if isinstance(value, np.ndarray):
            if value.dtype == object:
                raise NotStorable("an array of objects")
            held = io.BytesIO()
            np.save(held, value)
            return {"array": base64.b64encode(held.getvalue()).decode()}
        if isinstance(value, np.generic):
            return self._encoded(value.item(), folder, seen)
        if isinstance(value, Decimal):
            return {"decimal": str(value)}
        if isinstance(value, datetime | date):
            return {type(value).__name__: value.isoformat()}
        if isinstance(value, tuple | list):
            return {type(value).__name__: [self._encoded(v, folder, seen) for v in value]}
        if isinstance(value, dict) and all(isinstance(k, str) for k in value):
            return {"dict": {k: self._encoded(v, folder, seen) for k, v in value.items()}}
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            names = [f.name for f in dataclasses.fields(value)]
            return {"class": f"{type(value).__module__}:{type(value).__qualname__}", "fields": {n: self._encoded(getattr(value, n), folder, seen) for n in names}}
        raise NotStorable(type(value).__name__)

    def _decoded(self, value: Any, folder: str, seen: dict[int, DataFrame]) -> Any:
        if not isinstance(value, dict):
            return value
        if "table" in value:
            k = value["table"]
            if k not in seen:
                seen[k] = self.spark.read.schema(T.StructType.fromJson(json.loads(value["schema"]))).parquet(f"{folder}/table-{k}")
            return seen[k]
        if "class" in value:
            module, name = value["class"].split(":")
            if not module.startswith("quillmat."):
                raise NotStorable(value["class"])
            return getattr(importlib.import_module(module), name)(**{k: self._decoded(v, folder, seen) for k, v in value["fields"].items()})
        (kind, held), *_ = value.items()
        if kind in ("tuple", "list"):
            return {"tuple": tuple, "list": list}[kind](self._decoded(v, folder, seen) for v in held)
        if kind == "dict":
            return {k: self._decoded(v, folder, seen) for k, v in held.items()}
        if kind == "array":
            return np.load(io.BytesIO(base64.b64decode(held)))
        return {"float": float.fromhex, "decimal": Decimal, "date": date.fromisoformat, "datetime": datetime.fromisoformat}[kind](held)

    def get(self, address: str) -> Any:
        """The value at an address; KeyError if there is none."""
        folder = self.folder(address)
        if not self._exists(f"{folder}/{MANIFEST}"):
            raise KeyError(address)
        self.hits += 1
        return self._decoded(json.loads(self._read(f"{folder}/{MANIFEST}"))["value"], folder, {})

    def put(self, address: str, value: Any, name: str = "") -> Any:
        """Write a value, unless another session has done so meanwhile, and return it as it is read back."""
        part = f"{self.root}/writing-{uuid.uuid4().hex}"
        try:
            manifest = {"name": name, "value": self._encoded(value, part, {})}
            self._write(f"{part}/{MANIFEST}", json.dumps(manifest))
            (source, fs), (target, _) = self._path(part), self._path(self.folder(address))
            fs.mkdirs(target.getParent())
            if not fs.exists(target):
                fs.rename(source, target)
                self.writes += 1
        finally:
            self._delete(part)
        self.hits -= 1
        return self.get(address)

    def keep(self, address: str, make: Callable[[], Any], name: str = "") -> Any:
        """What is stored at the address, or else what ``make`` gives, stored; nothing, and a value that can't be stored, is given as it is."""
        with contextlib.suppress(KeyError):
            return self.get(address)
        value = make()
        if value is None or (isinstance(value, dict | tuple) and not value):
            return value
        try:
            return self.put(address, value, name)
        except NotStorable:
            return value

    def entries(self) -> list[dict]:
        """address, name, bytes and milliseconds of last change of all stored values."""
        path, fs = self._path(self.root)
        out = []
        for group in fs.listStatus(path) if fs.exists(path) else []:
            if len(group.getPath().getName()) == 2:
                for found in fs.listStatus(group.getPath()):
                    name = str(found.getPath())
                    if self._exists(f"{name}/{MANIFEST}"):
                        out.append({"address": found.getPath().getName(), "name": json.loads(self._read(f"{name}/{MANIFEST}"))["name"], "bytes": fs.getContentSummary(found.getPath()).getLength(), "changed": found.getModificationTime()})
        return out

    def remove(self, address: str | None = None) -> int:
        """Delete one value, or all; how many there were.  Tables read from it before can't be read any more."""
        gone = [address] if address else [e["address"] for e in self.entries()]
        return sum(bool(self._exists(self.folder(a)) and self._delete(self.folder(a))) for a in gone)


_stores: dict[tuple[str, bool], Store] = {}


def default_store(spark: SparkSession, lasting: bool) -> Store:
    """The session's store; values whose address means nothing to another session go to a folder that is deleted with this one."""
    key = (spark.sparkContext.applicationId, lasting)
    if key not in _stores:
        if lasting:
            _stores[key] = Store(spark)
        else:
            own = Store(spark, f"{default_store(spark, True).root}/session-{uuid.uuid4().hex}")
            _stores[key] = own

            def leave() -> None:
                with contextlib.suppress(Exception):  # the session may have ended before
                    own._delete(own.root)

            atexit.register(leave)
    return _stores[key]
