"""Charges of a ledger as numbered files, of which each number is written once.

The charges of one name are numbered from zero. Whoever charges writes the next number that it has not seen,
complete, and only if nobody was faster: a file is written under a hidden name and then given its number by an
operation that fails if the number is taken (a hard link on a local disk, Hadoop's rename that does not overwrite elsewhere).
Who comes second has to read what the other has spent, and ask again whether its own spend still fits.

Files are small Parquet tables, so the folder is also the table of all spends.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

COLUMNS = pa.schema([
    ("session", pa.string()), ("partition", pa.string()), ("query", pa.string()), ("mechanism", pa.string()),
    ("epsilon", pa.float64()), ("delta", pa.float64()), ("rho", pa.float64()), ("ts", pa.timestamp("us", tz="UTC")),
])


class Charges:
    """The charges of one session name in a ledger's folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self._spark = spark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(self._path)
        self._prefix = f"charge-{hashlib.sha256(name.encode()).hexdigest()[:32]}-"
        #: The first number that this session has not seen.
        self.next = 0

    def _place(self, name: str):
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def number_of(self, file_name: str) -> int | None:
        """The number of a file of this name's charges; None for other files."""
        found = re.fullmatch(re.escape(self._prefix) + r"(\d+)\.parquet", file_name)
        return None if found is None else int(found[1])

    def _numbered(self, number: int):
        return self._place(f"{self._prefix}{number:012d}.parquet")

    def write(self, rows: Sequence[tuple]) -> bool:
        """Write the rows as the next charge; False if that number is taken."""
        body = io.BytesIO()
        pq.write_table(pa.Table.from_pylist([dict(zip(COLUMNS.names, row)) for row in rows], schema=COLUMNS), body)
        self._fs.mkdirs(self._path)
        hidden, final = self._place(f".{uuid.uuid4().hex}.tmp"), self._numbered(self.next)
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(body.getvalue()))
        finally:
            stream.close()
        try:
            if not self._take(hidden, final):
                return False
        finally:
            if self._fs.exists(hidden):
                self._fs.delete(hidden, False)
        self.next += 1
        return True

    def _take(self, hidden, final) -> bool:
        """Give the hidden file its number; False if the number is taken."""
        if self._fs.getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self._spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._spark.sparkContext._jsc.hadoopConfiguration()
        )
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self._spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(hidden, final, how)
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        return True

    def read_next(self) -> list[tuple] | None:
        """The rows of the first charge that was not seen yet; None if there is none."""
        place = self._numbered(self.next)
        if not self._fs.exists(place):
            return None
        stream = self._fs.open(place)
        try:
            body = bytes(stream.readAllBytes())
        finally:
            stream.close()
        self.next += 1
        return [tuple(row.values()) for row in pq.read_table(io.BytesIO(body)).to_pylist()]
