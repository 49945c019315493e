"""A versioned table of small changes: current rows, undo in stack order, rollback of any change.

A change writes two Parquet folders below ``folder``: the rows as they become
(``after``) and as they were (``before``, the before-images), both partitioned
by version. The current table is the base with each row's newest delta; the
base itself is never rewritten. Undo and rollback write a new version whose
rows are before-images, so that the log only grows and any version can be read.

Undo knows the last ``most_changes`` changes of at most ``most_rows`` rows
(larger ones are logged, but not in the stack), newest first; an undone change
leaves the stack. Rollback takes any change by its version, also after later
ones, which keep their effect on other rows; a version without before-images
rolls back nothing. Rows that are not in the base are ignored, and an unknown
column is an error. The log of versions is a table as well; what a session
holds of it is bounded by the stack.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class History:
    """Changes of one table, kept in ``folder`` (shared by driver and executors)."""

    def __init__(self, base: DataFrame, folder: str, key: str, columns: list[str], most_rows: int = 1000, most_changes: int = 25):
        self.base, self.folder, self.key, self.columns = base, folder.rstrip("/"), key, columns
        self.most_rows, self.most_changes, self.spark = most_rows, most_changes, base.sparkSession
        unknown = {key, *columns} - set(base.columns)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{part}")
        except AnalysisException:  # nothing written yet
            return None

    def log(self) -> DataFrame:
        """(version, kind, of, note, rows, stack): what was done, in order; ``of`` is the version that was undone or rolled back, ``stack`` what undo could take back then, the last one first."""
        found = self._read("log")
        return found if found is not None else self.spark.createDataFrame([], "version long, kind string, of long, note string, rows long, stack array<long>")

    def current(self, version: int | None = None) -> DataFrame:
        """The table now, or as a version left it."""
        after = self._read("after")
        if after is None:
            return self.base
        if version is not None:
            after = after.where(F.col("version") <= version)
        newest = after.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), "version").alias("_new"))
        joined = self.base.join(newest, self.key, "left")
        return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in self.columns else F.col(c) for c in self.base.columns])

    def _write(self, rows: DataFrame, kind: str, of: int | None, note: str) -> int:
        version = (self.log().agg(F.max("version")).first()[0] or 0) + 1
        new = rows.select(self.key, *self.columns)
        old = self.current().select(self.key, *self.columns).join(new.select(self.key), self.key, "left_semi")
        old.write.parquet(f"{self.folder}/before/version={version}")
        before = self.spark.read.schema(old.schema).parquet(f"{self.folder}/before/version={version}")
        known = before.select(self.key)
        new.join(known, self.key, "left_semi").write.parquet(f"{self.folder}/after/version={version}")
        stack, many = self.stack(), before.count()
        if kind == "undo":
            stack = stack[1:]
        elif kind == "change" and 0 < many <= self.most_rows:
            stack = [version, *stack][: self.most_changes]
        entry = self.spark.createDataFrame([(version, kind, of, note, many, stack)], "version long, kind string, of long, note string, rows long, stack array<long>")
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return version

    def change(self, rows: DataFrame, note: str = "") -> int:
        """Set the columns of the rows with these keys (one row each); the change's version."""
        return self._write(rows, "change", None, note)

    def stack(self) -> list[int]:
        """Versions that undo() would take back, the last one first: small enough, not undone yet, and never ``most_changes`` deep."""
        newest = self.log().orderBy(F.desc("version")).select("stack").first()
        return list(newest["stack"]) if newest else []

    def _before(self, version: int) -> DataFrame | None:
        found = self._read("before")
        return None if found is None else found.where(F.col("version") == version).drop("version")

    def undo(self) -> int | None:
        """Take the last change of the stack back; its version, or None where nothing is left."""
        left = self.stack()
        if not left:
            return None
        self._write(self._before(left[0]), "undo", left[0], "")
        return left[0]

    def rollback(self, version: int) -> int:
        """Put the rows of a change back as they were before it; how many."""
        old = self._before(version)
        rows = 0 if old is None else old.count()
        if rows:
            self._write(old, "rollback", version, "")
        return rows
