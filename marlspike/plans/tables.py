"""Tables of keyed rows that change: hash buckets, copy on write of the touched ones, a manifest switched last.

A version is a manifest, a small file that names the folder of each bucket. A write reads the buckets that its rows touch, writes those
whose content changes into a new folder and then puts the next manifest, which shares the folders of all other buckets. Until then, and
after a failure, readers see the version before. Two writers of one version: the second fails and may try again. Rows with a null in
a key aren't taken, and null keys delete nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlspike.plans import delete, lines_of, names, put, written

BUCKETS = 64


class Table:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, list(keys), buckets

    def version(self) -> int:
        """Number of the last version; -1 before the first write."""
        return max((int(n) for n in names(self.spark, f"{self.folder}/manifest") if n.isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        lines = lines_of(self.spark, f"{self.folder}/manifest/{version:010d}")
        return {int(bucket): path for bucket, path in (line.split(" ", 1) for line in lines if line)}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, p in self.manifest(version).items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _known(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=self.keys).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # as many as there are buckets at most

    def _replace(self, touched: list[int], content: DataFrame) -> int:
        """A version in which the touched buckets have this content."""
        before = self.version()
        data = f"data/{before + 1:010d}-{uuid.uuid4().hex}"
        content.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        # a bucket without rows has no folder
        filled = [int(n.split("=")[1]) for n in names(self.spark, f"{self.folder}/{data}") if n.startswith("bucket=")]
        manifest = {b: p for b, p in self.manifest(before).items() if b not in touched} | {b: f"{data}/bucket={b}" for b in filled}
        try:
            put(self.spark, f"{self.folder}/manifest/{before + 1:010d}", "\n".join(f"{b} {p}" for b, p in sorted(manifest.items())))
        except FileExistsError:
            delete(self.spark, f"{self.folder}/{data}")
            raise
        return before + 1

    def _change(self, candidates: DataFrame, changed: Callable[[DataFrame, DataFrame], DataFrame], keep_changed: bool = True) -> int:
        """changed(candidates, current rows) are the rows that enter (or with keep_changed False leave); nothing is written where there are none."""
        candidates = written(candidates, "table-candidates")
        change = written(changed(candidates, self.read(buckets=self._touched(candidates))), "table-change")
        touched = self._touched(change)
        if not touched:
            return self.version()
        rest = self.read(buckets=touched).join(change.select(self.keys), self.keys, "left_anti").select(self.schema.names)
        return self._replace(touched, rest.unionByName(change) if keep_changed else rest)

    def _one_each(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row for each key: the last by order, or else the least."""
        by = [F.desc(order)] if order else []
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*by, *[c for c in self.schema.names if c not in self.keys] or self.keys))
        return self._known(rows).withColumn("_n", place).where("_n = 1").drop("_n")

    def insert_ignore(self, rows: DataFrame) -> int:
        """Enters the rows whose key isn't there yet; of several for one key the least."""
        return self._change(self._one_each(rows, None), lambda new, old: new.join(old.select(self.keys), self.keys, "left_anti").select(self.schema.names))

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Enters the rows, in place of those with their keys; with an order, only what isn't older. Rows that are there already change nothing."""

        def changed(new: DataFrame, old: DataFrame) -> DataFrame:
            same = F.lit(True)
            for c in self.schema.names:
                same = same & new[c].eqNullSafe(old[c])
            met = F.lit(True)
            for k in self.keys:
                met = met & (new[k] == old[k])
            beats = ~same if order is None else ~same & F.coalesce(new[order] >= old[order], old[order].isNull())
            return new.join(old, met, "left").where(old[self.keys[0]].isNull() | beats).select(*[new[c] for c in self.schema.names])

        return self._change(self._one_each(rows, order), changed)

    def delete(self, gone: DataFrame, column: str | None = None) -> int:
        """Deletes the rows whose key is in gone, or whose column is."""
        if column is None:
            return self._change(gone.dropna(subset=self.keys).select(self.keys).distinct(), lambda keys, old: old.join(keys, self.keys, "left_semi").select(self.schema.names), keep_changed=False)
        found = self.read().join(gone.select(F.col(gone.columns[0]).alias(column)).distinct(), column, "left_semi").select(self.keys)
        return self._change(found, lambda keys, old: old.join(keys, self.keys, "left_semi").select(self.schema.names), keep_changed=False)

    def changed_since(self, version: int) -> list[int]:
        """The buckets whose content isn't that of a version."""
        before, now = self.manifest(version), self.manifest()
        return sorted(b for b in before.keys() | now.keys() if before.get(b) != now.get(b))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all manifests but the last so many, and the data that those left don't name. No write may run meanwhile."""
        found = [n for n in names(self.spark, f"{self.folder}/manifest") if n.isdigit()]
        named = {p.split("/")[1] for n in found[-keep:] for p in self.manifest(int(n)).values()}
        for n in found[:-keep]:
            delete(self.spark, f"{self.folder}/manifest/{n}")
        for n in set(names(self.spark, f"{self.folder}/data")) - named:
            delete(self.spark, f"{self.folder}/data/{n}")


def delete_cascade(gone: DataFrame, parent: Table, *children: tuple[Table, str]) -> None:
    """Deletes rows of parent by key (the one column of gone), and before them those of children that name them in a column: a run
    that fails half way leaves no row without its parent, and can be run again."""
    for child, column in children:
        child.delete(gone, column)
    parent.delete(gone)
