"""Collections that are built beside the live one and switched to at once.

A collection is a folder below ``<path>/collections``. ``<path>/pointer`` holds numbered files;
the highest whole one names the live collection and the one before. A switch creates the next
number exclusively, so of two at the same time one wins, and a writer that dies leaves either
nothing or a file that isn't whole, which readers pass over. Readers may hold a collection;
``clean_up`` deletes those that are neither live nor the one before, have been out of use for a
while, and are held by nobody.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Pointer:
    """A small value in numbered files of a folder, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _text(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Whether this call made the file; False if it was there."""
        at, fs = self._at(path)
        try:
            stream = fs.create(at, False)
        except Exception as e:  # Java's exception comes wrapped
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def history(self) -> list[tuple[int, dict]]:
        """(number, value) of the whole files, oldest first."""
        out = []
        for name in self._names(self.path):
            try:
                out.append((int(name), json.loads(self._text(f"{self.path}/{name}"))))
            except ValueError:  # not whole: its writer died, or still writes
                continue
        return out

    def read(self) -> tuple[int, dict] | None:
        whole = self.history()
        return whole[-1] if whole else None

    def write(self, value: dict, seen: int | None) -> bool:
        """Sets the value if nothing was set since number ``seen`` was read (None: nothing was)."""
        taken = [int(n) for n in self._names(self.path) if n.isdigit()]
        if any(n > (seen or 0) for n, _ in self.history()):
            return False
        return self._create(f"{self.path}/{max(taken, default=0) + 1:012d}", json.dumps(value))


class Shadow:
    """Live and shadow collections below ``path``."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.pointer = Pointer(spark, f"{self.path}/pointer")

    def folder(self, name: str) -> str:
        return f"{self.path}/collections/{name}"

    def current(self) -> str | None:
        held = self.pointer.read()
        return held[1]["current"] if held else None

    def previous(self) -> str | None:
        held = self.pointer.read()
        return held[1]["previous"] if held else None

    def create(self, rows: DataFrame) -> str:
        """A new collection that nobody reads yet; its name."""
        name = f"c{uuid.uuid4().hex}"
        rows.write.parquet(self.folder(name))
        return name

    def validate(self, name: str, least: float = 0.9) -> tuple[bool, str]:
        """Whether a collection may go live: it has rows, columns of the live one, and ``least`` times its rows or more."""
        new = self.spark.read.parquet(self.folder(name))
        n, live = new.count(), self.current()
        if not n:
            return False, "it is empty"
        if live is None:
            return True, f"{n} rows"
        old = self.spark.read.parquet(self.folder(live))
        if missing := set(old.columns) - set(new.columns):
            return False, f"it lacks {sorted(missing)}"
        before = old.count()
        return n >= least * before, f"{n} rows after {before}"

    def switch(self, name: str) -> bool:
        """Makes a collection live; False if another switch came first."""
        held = self.pointer.read()
        seen, live = (held[0], held[1]["current"]) if held else (None, None)
        return self.pointer.write({"current": name, "previous": live, "at": self.clock()}, seen)

    def roll_back(self) -> bool:
        """Back to the collection before; False if there is none or another switch came first."""
        held = self.pointer.read()
        if held is None or held[1]["previous"] is None:
            return False
        return self.pointer.write({"current": held[1]["previous"], "previous": held[1]["current"], "at": self.clock()}, held[0])

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder(self.current()))

    def hold(self, name: str, seconds: float) -> str:
        """Keeps a collection from being cleaned up for a while; what ``release`` takes."""
        lease = f"{self.path}/leases/{name}-{uuid.uuid4().hex}"
        self.pointer._create(lease, json.dumps({"name": name, "until": self.clock() + seconds}))
        return lease

    def release(self, lease: str) -> None:
        at, fs = self.pointer._at(lease)
        fs.delete(at, False)

    def clean_up(self, delay: float = 300.0) -> list[str]:
        """Deletes what nobody needs any more; the names. Collections that never went live count from their making."""
        now, out = self.clock(), []
        history = self.pointer.history()
        needed = {history[-1][1]["current"], history[-1][1]["previous"]} if history else set()
        left = {v["previous"]: v["at"] for _, v in history if v["previous"]}  # the last time each went out of use
        for lease in self.pointer._names(f"{self.path}/leases"):
            held = json.loads(self.pointer._text(f"{self.path}/leases/{lease}"))
            if held["until"] > now:
                needed.add(held["name"])
        for name in self.pointer._names(f"{self.path}/collections"):
            at, fs = self.pointer._at(self.folder(name))
            since = left.get(name, fs.getFileStatus(at).getModificationTime() / 1000)
            if name not in needed and now - since >= delay:
                fs.delete(at, True)
                out.append(name)
        return sorted(out)
