"""Seed bundles: a SQLite file with its digest and signature, read as DataFrames."""

from __future__ import annotations

import base64
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"INTEGER": "bigint", "TEXT": "string", "REAL": "double", "BLOB": "binary"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (part.low, part.high))


class SqliteSource(DataSource):
    """`spark.read.format("sqlite_bundle")` with path, table and parts; the file is on storage that all workers mount."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_bundle"

    def _columns(self) -> list[tuple[str, str]]:
        if not _NAME.match(self.options["table"]):
            raise ValueError("table is a plain name")
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            return [(r[1], _TYPES.get(r[2].upper(), "string")) for r in db.execute(f"PRAGMA table_info({self.options['table']})")]

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in self._columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], [n for n, _ in self._columns()], int(self.options.get("parts", "4")))


def read_table(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    """A table of a SQLite file, in ranges of row ids."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_bundle").options(path=path, table=table, parts=parts).load()


def digest(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file as hex, computed where it is read."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    return row["h"] if row else None


def verify(spark: SparkSession, path: str, digest_text: str | None, signature_base64: str | None, public_key_der: bytes) -> str:
    """`ok`, or what is wrong with a bundle: missing digest or signature, digest mismatch, malformed or bad signature.

    The signature is Ed25519 over the digest's hex text and is checked by the JVM.
    """
    if not digest_text or not digest_text.split():
        return "digest missing"
    said = digest_text.split()[0].lower()
    if not re.fullmatch(r"[0-9a-f]{64}", said):
        return "digest malformed"
    if digest(spark, path) != said:
        return "digest mismatch"
    if not signature_base64:
        return "signature missing"
    try:
        signature = base64.b64decode(signature_base64, validate=True)
    except ValueError:
        return "signature malformed"
    if len(signature) != 64:
        return "signature malformed"
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(public_key_der))
    check = jvm.java.security.Signature.getInstance("Ed25519")
    check.initVerify(key)
    check.update(said.encode())
    return "ok" if check.verify(signature) else "signature invalid"
