"""Versioned Parquet tables of knowledge bases.

A table is made of sets of rows, each written once, and of sets of removed keys,
each key with the number of the change that removed it: it takes away that key's
rows of earlier changes.  Adding or removing a document writes that document's
rows or key and nothing else.  Sets have levels: ``FAN`` of a level are written
together as one of the next, so a row is written once a level, and the number of
levels grows with the logarithm of the rows.  A set's key range is in its
manifest entry and its files have Bloom filters for what is looked up, so
publishing and point reads pass over sets and row groups that can't hold a key.

What sets there are stands in numbered manifests, written once and never changed;
the highest number counts, so readers see all of a run's changes or none, and a
run that breaks off anywhere leaves the manifest before it.  Files go through
Hadoop's file system, so a root can be on any store.

Points lie in folders by cell (``lectern.operators.cells``): publishing puts new points
into the cells of their nearest centres, and divides a cell that has grown too
large, whose rows in older sets are passed over from then on.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import KbExists, KbNotFound
from lectern.operators.cells import Cells, divide
from lectern.operators.retrieval import one_of
from lectern.schemas import TABLES

#: Schemes of stores where a file is seen, whole, once it is closed.
OBJECT_STORES = frozenset(["s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn"])
#: Keys up to which they are looked up one by one, by the files' Bloom filters; more are joined.
MOST_LISTED = 1000

class Files:
    """The few file operations that a store needs."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, again: bool = False) -> None:
        """Whole or not at all, to a name that must be free (unless it is written ``again``): of two writers one gets it.

        On an object store a file is seen when it is closed, and creating without
        overwriting is one step there.  Elsewhere a file of our own gets the name: by
        a link where files are local, by a rename otherwise; both fail on a name that is taken.
        """
        fs, target = self._at(path)
        if again:
            fs.delete(target, False)
        if str(fs.getScheme()) in OBJECT_STORES:
            self._put(fs, target, text, path)
            return
        _, own = self._at(f"{path}.{uuid.uuid4().hex}.part")
        self._put(fs, own, text, path)
        try:
            if str(fs.getScheme()) == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(target), local(own))
            elif not fs.rename(own, target):
                raise FileExistsError(f"{path} is there already")
        except Py4JJavaError as e:
            raise FileExistsError(f"{path} is there already") if fs.exists(target) else e
        finally:
            fs.delete(own, False)

    @staticmethod
    def _put(fs, p, text: str, path: str) -> None:
        try:
            stream = fs.create(p, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise FileExistsError(f"{path} is there already") if fs.exists(p) else e

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def _listed(self, path: str, folders: bool) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders) if fs.exists(p) else []

    def folders(self, path: str) -> list[str]:
        return self._listed(path, True)

    def files(self, path: str) -> list[str]:
        return self._listed(path, False)


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(", ")]


class Store:
    """Tables of all knowledge bases under a root."""

    #: Sets of a level that become one of the next.
    FAN = 8
    #: Manifests that stay for readers that have an older state open.
    KEPT_MANIFESTS = 3

    def __init__(self, spark: SparkSession, root: str, cell_points: int = 20_000):
        self.spark, self.root, self.files, self.cell_points = spark, root.rstrip("/"), Files(spark), cell_points
        # lists of keys are tested value by value in the files' filters, not by their range alone
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_LISTED))

    def _kb(self, kb: str) -> str:
        return f"{self.root}/kbs/{kb}"

    def _manifests(self, kb: str) -> list[str]:
        return [n for n in self.files.files(f"{self._kb(kb)}/manifests") if n.endswith(".json")]

    def names(self) -> list[str]:
        return self.files.folders(f"{self.root}/kbs")

    def exists(self, kb: str) -> bool:
        return bool(self._manifests(kb))

    def manifest(self, kb: str) -> dict:
        held = self._manifests(kb)
        if not held:
            raise KbNotFound(f"kb not found: {kb}")
        return json.loads(self.files.read(f"{self._kb(kb)}/manifests/{held[-1]}"))

    def _write_manifest(self, kb: str, manifest: dict) -> None:
        self.files.write(f"{self._kb(kb)}/manifests/{manifest['number']:012}.json", json.dumps(manifest))

    def create(self, kb: str, meta: dict) -> None:
        """The first manifest's name must be free, so of two callers one creates it."""
        try:
            if self.exists(kb):
                raise FileExistsError
            self._write_manifest(kb, {"number": 0, "meta": meta, "tables": {}})
        except FileExistsError:
            raise KbExists(f"kb already exists: {kb}") from None

    def drop(self, kb: str, tries: int = 8) -> None:
        """Without manifests a base is gone for readers; what can't be deleted at once is tried again."""
        self.manifest(kb)
        self.files.delete(f"{self._kb(kb)}/manifests")
        for attempt in range(tries):
            try:
                self.files.delete(self._kb(kb))
                return
            except Exception:
                if attempt + 1 == tries:
                    raise
                time.sleep(0.25 * (attempt + 1))

    # --- reading

    def _path(self, kb: str, table: str, version: str) -> str:
        # folders in folders are read together only where all are named as partitions are
        name = f"set={version}" if table in TABLES and TABLES[table].cell else version
        return f"{self._kb(kb)}/{table}/{name}"

    def _scan(self, kb: str, table: str, sets: list[dict]) -> DataFrame:
        """All rows of some sets, those of cells that were divided since left out."""
        of = TABLES[table]
        alike: dict[tuple, list[str]] = {}
        for s in sets:
            alike.setdefault(tuple(s.get("without", ())), []).append(self._path(kb, table, s["id"]))
        parts = []
        for without, paths in alike.items():
            scan = self.spark.read.schema(of.schema)
            scan = (scan.option("basePath", f"{self._kb(kb)}/{table}") if of.cell else scan).parquet(*paths).select(*_names(of.schema))
            parts.append(scan.where(~F.col(of.cell).isin(list(without))) if without else scan)
        return reduce(DataFrame.unionAll, parts)

    def _gone(self, kb: str, table: str, sets: list[dict]) -> DataFrame:
        """(_key, _from): removed keys with the latest change that removed each."""
        of = TABLES[table]
        kind = next(c.split(None, 1)[1] for c in of.schema.split(", ") if c.split()[0] == of.key)
        scan = self.spark.read.schema(f"_key {kind}, _from long").parquet(*(self._path(kb, table, g["id"]) for g in sets))
        return scan.groupBy("_key").agg(F.max("_from").alias("_from"))

    def _live(self, kb: str, table: str, held: dict, sets: list[dict]) -> DataFrame:
        """The rows of some sets that no later change removed."""
        key = TABLES[table].key
        last = max((g["number"] for g in held["gone"]), default=-1)
        later, sooner = [s for s in sets if s["number"] >= last], [s for s in sets if s["number"] < last]
        parts = [self._scan(kb, table, later)] if later else []
        if sooner:
            by_number: dict[int, list[dict]] = {}
            for s in sooner:
                by_number.setdefault(s["number"], []).append(s)
            rows = reduce(DataFrame.unionAll, [self._scan(kb, table, some).withColumn("_number", F.lit(n).cast("long")) for n, some in by_number.items()])
            parts.append(rows.join(self._gone(kb, table, held["gone"]), (F.col(key) == F.col("_key")) & (F.col("_number") < F.col("_from")), "left_anti").drop("_number"))
        return reduce(DataFrame.unionAll, parts)

    def read(self, kb: str, table: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table; with a manifest, as that one has them."""
        held = (manifest or self.manifest(kb))["tables"].get(table, {"rows": []})
        if not held["rows"]:
            return self.spark.createDataFrame([], TABLES[table].schema)
        return self._live(kb, table, held, held["rows"])

    def matching(self, kb: str, table: str, column: str, values: DataFrame, manifest: dict | None = None) -> DataFrame:
        """The rows of a table whose column has one of the values of a frame's one column.

        Few values are named, so the files' filters tell which row groups have them; more are joined.
        """
        values = values.select(F.col(values.columns[0]).alias("_value")).where("_value IS NOT NULL").distinct()
        few = [r[0] for r in values.limit(MOST_LISTED + 1).collect()]
        rows = self.read(kb, table, manifest)
        if len(few) <= MOST_LISTED:
            return rows.where(one_of(column, few))
        return rows.join(values, F.col(column) == F.col("_value"), "left_semi")

    def cells(self, kb: str, manifest: dict | None = None) -> Cells | None:
        """The cells of a base's points; none while there are too few to have any."""
        held = (manifest or self.manifest(kb)).get("cells")
        return Cells.read(self.spark, f"{self._kb(kb)}/cells/{held['id']}", held) if held else None

    # --- writing

    def _write(self, kb: str, table: str, df: DataFrame, level: int, number: int, manifest: dict) -> dict | None:
        """Writes a set of rows; its entry, or none if it has no rows."""
        of, version = TABLES[table], uuid.uuid4().hex
        path = self._path(kb, table, version)
        rows = df.select(*_names(of.schema))
        if of.cell:
            rows = rows.hint("rebalance", of.cell).sortWithinPartitions(of.cell, *of.order)
        elif level:
            rows = rows.repartitionByRange(*of.order).sortWithinPartitions(*of.order)
        else:
            rows = rows.sortWithinPartitions(*of.order)
        writer = rows.write.mode("errorifexists").option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in of.looked_up:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (writer.partitionBy(of.cell) if of.cell else writer).parquet(path)
        told = self.spark.read.schema(of.schema).parquet(path).agg(F.count("*").alias("n"), F.min(of.key).alias("low"), F.max(of.key).alias("high")).first()
        if not told.n:
            self.files.delete(path)
            return None
        held = manifest["tables"][table]
        held["written"] = held.get("written", 0) + told.n
        return {"id": version, "number": number, "level": level, "rows": told.n, "low": told.low, "high": told.high}

    def _write_gone(self, kb: str, table: str, keys: DataFrame, level: int, number: int) -> dict | None:
        version = uuid.uuid4().hex
        path = self._path(kb, table, version)
        keys.select("_key", F.col("_from").cast("long").alias("_from")).write.mode("errorifexists").parquet(path)
        n = self.spark.read.schema(keys.schema).parquet(path).count()
        if not n:
            self.files.delete(path)
            return None
        return {"id": version, "number": number, "level": level, "rows": n}

    def _replaced(self, kb: str, table: str, before: dict, keys: DataFrame) -> DataFrame | None:
        """Which of some keys have rows before this change; none if the sets' key ranges say so already."""
        of, held = TABLES[table], before["tables"].get(table, {"rows": []})
        keys = keys.select(F.col(of.key).alias("_key")).where("_key IS NOT NULL").distinct()
        span = keys.agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("n")).first()
        sets = [s for s in held["rows"] if span.n and s["low"] is not None and s["low"] <= span.high and span.low <= s["high"]]
        if not sets:
            return None
        there = self._live(kb, table, held, sets).select(F.col(of.key).alias("_key"))
        if span.n <= MOST_LISTED:
            return there.where(one_of("_key", [r["_key"] for r in keys.collect()])).distinct()
        return keys.join(there, "_key", "left_semi")

    def publish(self, kb: str, added: dict[str, DataFrame] | None = None, removed: dict[str, DataFrame] | None = None, note: dict | None = None) -> None:
        """Writes new rows and removed keys of tables, then the manifest that names them.

        Rows of ``added`` take the place of those with the same key; ``removed`` are
        frames with the key column.  Points get their cells.  Levels that are full are written together, and sets
        that no kept manifest names go afterwards.  The manifest keeps the ``note``
        until the next one, so what it says is known exactly if the change was made.
        """
        manifest = self.manifest(kb)
        manifest["note"] = note
        before = json.loads(json.dumps(manifest))
        manifest["number"] += 1
        number, added, removed = manifest["number"], dict(added or {}), removed or {}
        gone_now: dict[str, dict | None] = {}
        for table in sorted({**added, **removed}, key=lambda t: TABLES[t].leader is not None):
            of = TABLES[table]
            held = manifest["tables"].setdefault(table, {"rows": [], "gone": []})
            new = None
            if table in added:
                rows = added[table]
                if of.cell:
                    cells = self.cells(kb, before)
                    rows = rows.drop(of.cell).withColumn(of.cell, cells.of(F.col("packed")) if cells else F.lit(0))
                new = self._write(kb, table, rows, 0, number, manifest)
            names = [df.select(of.key) for df in (removed.get(table), self._scan(kb, table, [new]) if new else None) if df is not None]
            if of.leader in gone_now:  # lists have no order by key: their leader's keys are theirs
                led = gone_now[of.leader]
                replaced = self._gone(kb, of.leader, [led]).select("_key") if led and before["tables"].get(table, {}).get("rows") else None
            else:
                replaced = self._replaced(kb, table, before, reduce(DataFrame.unionAll, names)) if names else None
            gone = self._write_gone(kb, table, replaced.withColumn("_from", F.lit(number)), 0, number) if replaced is not None else None
            gone_now[table] = gone
            held["gone"] += [gone] if gone else []
            held["rows"] += [new] if new else []
            if new and of.cell:
                self._divide_cells(kb, manifest, new)
            self._level(kb, table, manifest)
        self._write_manifest(kb, manifest)
        self._clean(kb)

    def _level(self, kb: str, table: str, manifest: dict) -> None:
        """Writes the sets of full levels together."""
        held, number, level = manifest["tables"][table], manifest["number"], 0
        while any(s["level"] >= level for s in held["rows"] + held["gone"]):
            group = [s for s in held["rows"] if s["level"] == level]
            if len(group) >= self.FAN:
                one = self._write(kb, table, self._live(kb, table, held, group), level + 1, number, manifest)
                held["rows"] = [s for s in held["rows"] if s not in group] + ([one] if one else [])
            group = [s for s in held["gone"] if s["level"] == level]
            if len(group) >= self.FAN:
                one = self._write_gone(kb, table, self._gone(kb, table, group), level + 1, max(s["number"] for s in group))
                held["gone"] = [s for s in held["gone"] if s not in group] + ([one] if one else [])
            level += 1
        # keys that were removed before all rows were written take nothing away any more
        oldest = min((s["number"] for s in held["rows"]), default=number)
        held["gone"] = [g for g in held["gone"] if g["number"] > oldest]

    def _divide_cells(self, kb: str, manifest: dict, new: dict) -> None:
        """Counts new points into their cells; divides cells that have grown too large and moves their points."""
        of, held = TABLES["points"], manifest["tables"]["points"]
        cells = self.cells(kb, manifest) or Cells.one(self.cell_points)
        added = {r["cell"]: r["n"] for r in self._scan(kb, "points", [new]).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        large = cells.grown(added)
        if large:
            rows = self.read(kb, "points", manifest).where(F.col("cell").isin(large))
            children = divide(cells, rows, large)
            if children:
                moved = rows.where(F.col("cell").isin(list(children))).withColumn("cell", cells.of_children(F.col("cell"), F.col("packed"), children))
                level = max(s["level"] for s in held["rows"])
                one = self._write(kb, "points", moved, level, manifest["number"], manifest)
                for s in held["rows"]:
                    s["without"] = sorted({*s.get("without", ()), *children})
                held["rows"].append(one)
                counts = {r["cell"]: r["n"] for r in self._scan(kb, "points", [one]).groupBy("cell").agg(F.count("*").alias("n")).collect()}
                cells.replace(children, counts)
                cells.measure(self.read(kb, "points", manifest))
        where = (manifest.get("cells") or {}).get("id")
        if cells.changed or where is None:  # counts change with each publish, centres seldom
            where = uuid.uuid4().hex
            cells.write(self.spark, f"{self._kb(kb)}/cells/{where}")
        manifest["cells"] = {"id": where, **cells.facts()}

    def _clean(self, kb: str) -> None:
        """Drops old manifests, and sets that none of the kept ones names."""
        old = self._manifests(kb)
        for name in old[: -self.KEPT_MANIFESTS]:
            self.files.delete(f"{self._kb(kb)}/manifests/{name}")
        kept = [json.loads(self.files.read(f"{self._kb(kb)}/manifests/{n}")) for n in old[-self.KEPT_MANIFESTS :]]
        named = {s["id"] for m in kept for held in m["tables"].values() for s in held["rows"] + held["gone"]} | {m["cells"]["id"] for m in kept if m.get("cells")}
        for table in (*TABLES, "cells"):
            for version in (n.removeprefix("set=") for n in self.files.folders(f"{self._kb(kb)}/{table}")):
                if version not in named:
                    self.files.delete(self._path(kb, table, version))
