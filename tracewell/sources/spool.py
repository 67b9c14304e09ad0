"""Standard input as a stream: the driver lays what comes in as files into a folder that a stream reads.

A cluster cannot read the driver's pipe, so its lines take one step more: pieces of whole lines are
written under a name that readers pass over and then renamed, so a stream never sees half a piece. The
folder lies in any store that Spark reads.
"""

from __future__ import annotations

import os
import threading
import time
from typing import BinaryIO

from pyspark.sql import SparkSession

#: Bytes of a piece, about.
PIECE = 8 << 20


class Spool(threading.Thread):
    """Copies a binary stream to ``folder`` until it ends; ``error`` holds what stopped it early."""

    def __init__(self, spark: SparkSession, source: BinaryIO, folder: str, every: float = 1.0):
        super().__init__(daemon=True)
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(folder))
        self.source, self.folder, self.every = source, folder, every
        self.begun, self.pieces, self.error = f"{time.time_ns():020d}", 0, None

    def run(self) -> None:
        try:
            held, since = b"", time.time()
            read = getattr(self.source, "read1", self.source.read)
            while data := read(1 << 16):
                held += data
                if len(held) >= PIECE or time.time() - since >= self.every:
                    cut = held.rfind(b"\n") + 1
                    self._put(held[:cut])
                    held, since = held[cut:], time.time()
            self._put(held)
        except Exception as e:
            self.error = e

    def _put(self, data: bytes) -> None:
        if not data:
            return
        name = f"{self.begun}-{self.pieces:08d}.txt"
        hidden, shown = (self.path(os.path.join(self.folder, n)) for n in (f"_{name}", name))
        out = self.files.create(hidden)
        out.write(bytearray(data))
        out.close()
        self.files.rename(hidden, shown)
        self.pieces += 1
