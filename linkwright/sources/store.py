"""Tables and reports that a run leaves behind, named after the settings that made them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkwright.config import DEFAULT, Settings
from linkwright.sources import files


class Store:
    """Parquet tables under `folder`/<fingerprint of the settings>: a changed setting never meets an old table."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> None:
        self.spark, self.folder = spark, f"{folder}/{settings.fingerprint()}"
        self._rebuilt: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return files.exists(f"{self.path(name)}/_SUCCESS")

    def stale(self, name: str, force: bool) -> bool:
        """Whether the table has to be built: it is not there, or is to be rebuilt and this run has not done so yet."""
        return not self.exists(name) or (force and name not in self._rebuilt)

    def materialize(self, name: str, build: Callable[[], DataFrame], *, force: bool = False, by: list[str] | None = None) -> DataFrame:
        """The table, built and written unless it is complete already; with `force` built again, once in a run.

        It is written aside and takes its place when complete: a table that the build itself reads, or a run that fails, does no harm.
        """
        if self.stale(name, force):
            aside = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
            w = build().write
            (w.partitionBy(*by) if by else w).parquet(aside)
            files.replace(aside, self.path(name))
            self._rebuilt |= {name} if force else set()
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        """A written table; FileNotFoundError if there is none."""
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        return self.spark.read.parquet(self.path(name))


def write_json(path: str, value: object) -> None:
    files.write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_text(path: str, lines: list[str]) -> None:
    files.write_text(path, "\n".join(lines) + "\n")


def save_threshold(path: str, threshold: float, f05: float) -> None:
    write_json(path, {"threshold": threshold, "macro_f05": f05})


def load_threshold(path: str, default: float = DEFAULT.default_threshold) -> tuple[float, str | None]:
    """(threshold, warning): the stored one, or the default with a warning."""
    if not files.exists(path):
        return default, f"no stored threshold at {path}, using {default}"
    return float(json.loads(files.read_text(path))["threshold"]), None


def report_rows(df: DataFrame, most: int = 100) -> list[dict]:
    """A small result table as dictionaries; beyond `most` rows the last one says how many follow."""
    rows = [r.asDict() for r in df.limit(most).collect()]
    more = df.count() - most if len(rows) == most else 0
    return rows + ([{"more_rows": more}] if more > 0 else [])


def report_lines(title: str, df: DataFrame, most: int = 100) -> list[str]:
    """The same as text."""
    return [title, *["  " + "  ".join(f"{c}={v}" for c, v in r.items()) for r in report_rows(df, most)], ""]
