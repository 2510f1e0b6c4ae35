"""Object stores through Hadoop's file systems: the same code for local folders, HDFS, S3 and the like."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stat:
    key: str
    size: int
    modified: float


class Store:
    """Objects below one URI. Keys are relative and can't leave it."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, resolve(spark, uri).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.hadoop.io.IOUtils

    def url(self, key: str = "") -> str:
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"the key {key!r} leaves the store")
        return f"{self.uri}/{key}" if key else self.uri

    def _at(self, key: str):
        return self._path(self.url(key))

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def get(self, key: str) -> bytes:
        return self.get_range(key, 0, self.size(key))

    def get_range(self, key: str, start: int, length: int) -> bytes:
        jvm = self.spark.sparkContext._jvm
        stream = self._fs.open(self._at(key))
        try:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()

    def get_suffix(self, key: str, length: int) -> bytes:
        size = self.size(key)
        return self.get_range(key, max(0, size - length), min(size, length))

    def put(self, key: str, data: bytes) -> None:
        """Writes beside the target and renames over it, so that readers see the old or the new object."""
        jvm = self.spark.sparkContext._jvm
        target, beside = self._at(key), self._path(f"{self.url(key)}.{time.time_ns()}.tmp")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        array[0] = rename
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(beside, target, array)
        except Exception:  # stores without an atomic rename put objects whole anyway
            self._fs.delete(target, False)
            self._fs.rename(beside, target)

    def rename(self, key: str, to: str) -> None:
        """Moves an object, over the one that has the name."""
        target = self._at(to)
        self._fs.mkdirs(target.getParent())
        self._fs.delete(target, False)
        if not self._fs.rename(self._at(key), target):
            raise OSError(f"{key} could not be moved to {to}")

    def stat(self, key: str) -> Stat:
        s = self._fs.getFileStatus(self._at(key))
        return Stat(key, s.getLen(), s.getModificationTime() / 1000)

    def size(self, key: str) -> int:
        return self.stat(key).size

    def modified_at(self, key: str) -> float:
        return self.stat(key).modified

    def delete(self, key: str) -> None:
        self._fs.delete(self._at(key), True)

    def list(self, prefix: str = "") -> list[Stat]:
        """Objects whose key begins with a prefix, in order of keys."""
        folder = prefix.rpartition("/")[0]
        if not self.exists(folder):
            return []
        found, files = [], self._fs.listFiles(self._at(folder), True)
        root = self._fs.makeQualified(self._at("")).toString().rstrip("/")
        while files.hasNext():
            s = files.next()
            key = s.getPath().toString().removeprefix(root).lstrip("/")
            if key.startswith(prefix) and not key.endswith((".crc", ".tmp")):
                found.append(Stat(key, s.getLen(), s.getModificationTime() / 1000))
        return sorted(found, key=lambda s: s.key)


def resolve(spark: SparkSession, uri: str) -> str:
    """A URI that Hadoop opens. ``s3`` and ``r2`` become ``s3a``, with endpoints from the environment; a bare path is a file."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return "file://" + os.path.abspath(uri)
    if scheme in ("s3", "r2", "s3a"):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for key, value in s3_settings(scheme, os.environ).items():
            conf.set(key, value)
        return f"s3a://{rest}"
    if scheme not in ("file", "hdfs", "viewfs", "gs", "abfs", "abfss"):
        raise ValueError(f"unknown scheme {scheme!r}")
    return uri


def s3_settings(scheme: str, env) -> dict[str, str]:
    """Hadoop settings for S3 and what speaks its protocol."""
    out = {}
    if scheme == "r2":
        if not (account := env.get("R2_ACCOUNT_ID")):
            raise ValueError("R2_ACCOUNT_ID is not set")
        out |= {"fs.s3a.endpoint": f"https://{account}.r2.cloudflarestorage.com", "fs.s3a.endpoint.region": "auto", "fs.s3a.path.style.access": "true"}
        names = ("R2_ACCESS_KEY_ID", "R2_SECRET_ACCESS_KEY")
    else:
        names = ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY")
        if endpoint := env.get("S3_ENDPOINT_URL"):
            out |= {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": "true"}
        if region := env.get("AWS_REGION"):
            out["fs.s3a.endpoint.region"] = region
    for name, key in zip(names, ("fs.s3a.access.key", "fs.s3a.secret.key"), strict=True):
        if name in env:
            out[key] = env[name]
    return out


def self_check(store: Store) -> dict[str, float]:
    """Milliseconds of each kind of access, on an object that is removed again; wrong answers raise."""
    key, data, out = f"check/{time.time_ns()}", bytes(range(256)) * 16, {}

    def timed(name, call, want=None):
        began = time.perf_counter()
        got = call()
        out[name] = (time.perf_counter() - began) * 1000
        if want is not None and got != want:
            raise ValueError(f"{name} gave {got!r}")

    timed("put", lambda: store.put(key, data))
    timed("exists", lambda: store.exists(key), True)
    timed("size", lambda: store.size(key), len(data))
    timed("get", lambda: store.get(key), data)
    timed("get_range", lambda: store.get_range(key, 100, 64), data[100:164])
    timed("get_suffix", lambda: store.get_suffix(key, 10), data[-10:])
    timed("list", lambda: [s.key for s in store.list("check/") if s.key == key], [key])
    timed("delete", lambda: store.delete(key))
    return out
