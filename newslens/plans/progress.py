"""Which stages of a run are finished, so that a broken run goes on at the stage that broke.

A stage's record is a small file, put in place whole when the stage's tables are written. It
holds a digest of the stage's inputs and parameters and of the record before it. A stage is
skipped if its record has the same digest; one whose inputs or parameters changed is done
again, and so is every stage behind it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from newslens.sources.sinks import Folder


def input_of(df: DataFrame | None) -> str | None:
    """A digest of an input's plan and of the files it reads; files that are written anew have new names.

    It is the same in every session. Rows that are in no file do not count.
    """
    if df is None:
        return None
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    return sha256("\n".join([plan, *sorted(df.inputFiles())]).encode()).hexdigest()


class Progress:
    """Records below ``folder``; without a folder nothing is kept and every stage runs."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self._folder = Folder(spark, folder) if spark is not None and folder else None
        self._digest = ""

    def stage(self, name: str, named: dict, work: Callable[[], None]) -> bool:
        """``work()``, unless the stage is finished with what ``named`` holds; whether it was done."""
        text = json.dumps([self._digest, name, named], sort_keys=True, default=str)
        mine = self._digest = sha256(text.encode()).hexdigest()
        if self._folder is None:
            work()
            return True
        record = f"{name}-{mine[:32]}"
        there = [n for n in self._folder.names() if n.startswith(f"{name}-")]
        if record in there:
            return False
        for old in there:
            self._folder.delete(old)
        work()
        self._digest = mine  # whatever stages ``work`` had of its own
        self._folder.put(record, text)
        return True

    def end(self) -> None:
        """Forget all records: the run is complete, and the next one begins at the first stage."""
        if self._folder is not None:
            for name in self._folder.names():
                self._folder.delete(name)
