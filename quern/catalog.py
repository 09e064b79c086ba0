"""Databases of versioned tables, kept as immutable Parquet parts.

A table version is a list of parts. INSERT adds a part; UPDATE and DELETE write
one new part list; nothing is changed in place. So a transaction is a copy of
the version map, ROLLBACK puts it back, readers keep what they see, and a lost
executor costs a retry only. Versions drive incremental snapshots.

The version map itself is a small file in the root, written anew after each
statement outside a transaction and at COMMIT, so a new session on the same
root finds all committed tables. Changes go to the change feed, which streams
can follow, at the same moments: what was rolled back is never seen there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import relational as R
from .types import ColumnDef, TableDef, parse_type


class CatalogError(ValueError):
    pass


class ConstraintError(CatalogError):
    pass


CHANGE_SCHEMA = "seq long, op string, table_name string, data string"
SYSTEM_TABLES = ("system_config", "system_roles", "system_role_permissions", "system_users", "system_user_roles")


@dataclass(frozen=True)
class Version:
    definition: TableDef
    parts: tuple[str, ...]
    number: int
    next_id: int = 1


class Database:
    def __init__(self, spark: SparkSession, name: str, root: str, codec: str = "zstd"):
        """``codec``: how the parts of tables and of the change feed are compressed, one of ``files.CODECS``."""
        self.spark, self.name, self.root, self.codec = spark, name, f"{root.rstrip('/')}/{name}", codec
        self.tables: dict[str, Version] = {}
        self._saved: dict[str, Version] | None = None
        self._seq = 0
        #: Changes of the running transaction: operation, table, rows.
        self._pending: list[tuple[str, str, DataFrame]] = []
        self._recover()

    # ---- definitions

    def create_table(self, definition: TableDef, *, if_not_exists: bool = False) -> None:
        key = definition.name.lower()
        if key in self.tables:
            if if_not_exists:
                return
            raise CatalogError(f"table {definition.name} exists")
        names = [c.name.lower() for c in definition.columns]
        if len(set(names)) < len(names) or not names:
            raise CatalogError("columns must have different names")
        self.tables[key] = Version(definition, (), 1)
        self.refresh(key)
        self._publish()

    def version(self, name: str) -> Version:
        if name.lower() not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name.lower()]

    def drop_table(self, name: str, *, if_exists: bool = False) -> None:
        if name.lower() in SYSTEM_TABLES:
            raise CatalogError("system tables cannot be dropped")
        if name.lower() not in self.tables:
            if if_exists:
                return
            raise CatalogError(f"no table {name}")
        del self.tables[name.lower()]
        self.spark.catalog.dropTempView(name.lower())
        self._publish()

    def alter(self, name: str, action: str, column: str, *, definition: ColumnDef | None = None, new_name: str | None = None) -> None:
        old = self.version(name)
        columns = list(old.definition.columns)
        df = self.df(name)
        if action == "add":
            if any(c.name.lower() == column.lower() for c in columns):
                raise CatalogError(f"column {column} exists")
            value = F.expr(definition.default) if definition.default is not None else F.lit(None)
            columns, df = [*columns, definition], df.withColumn(column, value.cast(definition.kind))
        else:
            found = old.definition.column(column)
            at = columns.index(found)
            if action == "drop":
                if found.primary_key or len(columns) == 1:
                    raise CatalogError(f"column {column} cannot be dropped")
                del columns[at]
                df = df.drop(found.name)
            elif action == "modify":
                columns[at] = replace(definition, name=found.name, primary_key=found.primary_key)
                df = df.withColumn(found.name, F.col(found.name).cast(definition.kind))
            else:
                if any(c.name.lower() == new_name.lower() for c in columns):
                    raise CatalogError(f"column {new_name} exists")
                columns[at] = replace(found, name=new_name)
                df = df.withColumnRenamed(found.name, new_name)
        self._replace(name, df, old.definition.with_columns(columns))

    def add_index(self, table: str, index: dict) -> None:
        """Recorded only: results and plans never depend on it."""
        old = self.version(table)
        for column in index["columns"]:
            old.definition.column(column)
        self.tables[table.lower()] = replace(old, definition=replace(old.definition, indexes=(*old.definition.indexes, index)))
        self._publish()

    # ---- rows

    def df(self, name: str) -> DataFrame:
        version = self.version(name)
        if not version.parts:
            return self.spark.createDataFrame([], version.definition.schema)
        return self.spark.read.schema(version.definition.schema).parquet(*version.parts)

    def refresh(self, name: str) -> None:
        self.df(name).createOrReplaceTempView(name.lower())

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name.lower()}/part-{uuid.uuid4().hex}"
        df.write.option("compression", self.codec).parquet(path)
        return path

    def _replace(self, name: str, df: DataFrame, definition: TableDef) -> None:
        old = self.version(name)
        part = self._write(name, df)
        self.tables[name.lower()] = replace(old, definition=definition, parts=(part,), number=old.number + 1)
        self.refresh(name)
        self._publish()

    def _discard(self, path: str) -> None:
        """Remove a part that no version has."""
        folder = self._path(path)
        self._files(folder).delete(folder, True)

    def _change(self, op: str, name: str, rows: DataFrame) -> None:
        self._pending.append((op, name.lower(), rows))

    def _publish(self) -> None:
        """Unless a transaction runs: write the version map, then the changes since the last time."""
        if self._saved is not None:
            return
        entries = {n: {"ddl": ddl(v.definition), "indexes": list(v.definition.indexes), "parts": list(v.parts), "number": v.number, "next_id": v.next_id} for n, v in self.tables.items()}
        pending, self._pending = self._pending, []
        seq, self._seq = self._seq, self._seq + len(pending)
        self._store(json.dumps({"tables": entries, "seq": self._seq}))
        for op, name, rows in pending:
            seq += 1
            out = rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(name).alias("table_name"), F.to_json(F.struct("*")).alias("data"))
            out.write.mode("append").option("compression", self.codec).parquet(self.feed_path)

    # ---- the version map, through the file system of the root

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _store(self, text: str) -> None:
        """As the next numbered file: whole under another name first, then renamed; older ones go."""
        folder = self._path(f"{self.root}/_versions")
        files = self._files(folder)
        self._map += 1
        new = self._path(f"{self.root}/_versions/_{self._map:012d}")
        out = files.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(new, self._path(f"{self.root}/_versions/{self._map:012d}")):
            raise CatalogError(f"another session has changed {self.name}")
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.lstrip("_").isdigit() and int(name.lstrip("_")) < self._map - 1:
                files.delete(status.getPath(), False)

    def _recover(self) -> None:
        """Take the newest version map in the root, if there is one."""
        from .plans.dialect import table_definition

        self._map = 0
        folder = self._path(f"{self.root}/_versions")
        files = self._files(folder)
        if not files.exists(folder):
            return
        stored = [n for n in (x.getPath().getName() for x in files.listStatus(folder)) if n.isdigit()]
        if not stored:
            return
        self._map = int(max(stored))
        found = json.loads(self.spark.read.text(f"{self.root}/_versions/{max(stored)}", wholetext=True).first()[0])
        self._seq = found["seq"]
        for name, entry in found["tables"].items():
            definition = replace(table_definition(entry["ddl"]), indexes=tuple(entry["indexes"]))
            self.tables[name] = Version(definition, tuple(entry["parts"]), entry["number"], entry["next_id"])
            self.refresh(name)

    @property
    def feed_path(self) -> str:
        return f"{self.root}/_changes"

    def insert(self, name: str, rows: DataFrame, *, ignore: bool = False) -> int:
        """Append rows (a subset of the columns by name); number of rows added."""
        old = self.version(name)
        definition = old.definition
        given = {c.lower(): c for c in rows.columns}
        unknown = [c for c in given if c not in {d.name.lower() for d in definition.columns}]
        if unknown:
            raise CatalogError(f"no column {unknown[0]} in {name}")
        columns, auto = [], None
        for c in definition.columns:
            value = F.col(given[c.name.lower()]) if c.name.lower() in given else F.expr(c.default) if c.default is not None else F.lit(None)
            if c.auto_increment:
                auto = c.name
            columns.append(value.cast(c.kind).alias(c.name))
        new = rows.select(*columns)
        path = self._write(name, self._with_numbers(name, new, auto, old.next_id) if auto else new)
        staged = self.spark.read.schema(definition.schema).parquet(path)
        keys = [key for key in [definition.key, *([c.name] for c in definition.columns if c.unique)] if key]
        try:
            self._check(definition, staged)
            for key in [] if ignore else keys:
                twice = staged.groupBy(*key).count().filter("count > 1").select(*key)
                if not twice.union(staged.join(self.df(name), key, "left_semi").select(*key)).isEmpty():
                    raise ConstraintError(f"duplicate key {', '.join(key)} in {name}")
        except ConstraintError:
            self._discard(path)
            raise
        if ignore and keys:
            for key in keys:
                staged = staged.dropDuplicates(key).join(self.df(name).select(*key), key, "left_anti").select(*definition.schema.names)
            first, path = path, self._write(name, staged)
            self._discard(first)
        fresh = self.spark.read.schema(definition.schema).parquet(path)
        count = fresh.count()
        if not count:
            self._discard(path)
            return 0
        top = fresh.agg(F.max(auto)).first()[0] if auto else None
        self.tables[name.lower()] = replace(old, parts=(*old.parts, path), number=old.number + 1, next_id=max(old.next_id, int(top) + 1 if top is not None else 1))
        self._change("INSERT", name, fresh)
        self.refresh(name)
        self._publish()
        return count

    def _with_numbers(self, name: str, rows: DataFrame, auto: str, start: int) -> DataFrame:
        """Missing values of the AUTO_INCREMENT column counted from ``start``, in the rows' order within partitions.

        Rows are stored first with their partition and place, then each
        partition starts where the ones before it end; the counts, one row a
        partition, are all that is gathered.
        """
        place = F.monotonically_increasing_id()
        part = F.shiftright(place, 33)
        path = self._write(name, rows.withColumn("__part", part).withColumn("__at", place - F.shiftleft(part, 33)))
        stored = self.spark.read.parquet(path)
        counts = stored.groupBy("__part").count()
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
        kind = rows.schema[auto].dataType
        numbered = stored.join(starts, "__part").withColumn(auto, F.coalesce(F.col(auto), (F.col("__start") + F.col("__at") + start).cast(kind)))
        return numbered.select(*rows.columns)

    def _check(self, definition: TableDef, rows: DataFrame) -> None:
        broken = F.lit(False)
        for c in definition.columns:
            x = F.col(c.name)
            if c.not_null or c.primary_key:
                broken = broken | x.isNull()
            if c.meta.get("unsigned"):
                broken = broken | F.coalesce(x < 0, F.lit(False))
            if "dimension" in c.meta:
                broken = broken | F.coalesce(F.size(x) != c.meta["dimension"], F.lit(False))
            if "length" in c.meta:
                broken = broken | F.coalesce(F.char_length(x) > c.meta["length"], F.lit(False))
            if isinstance(c.kind, T.FloatType | T.DoubleType):
                broken = broken | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
        if not rows.filter(broken).isEmpty():
            raise ConstraintError(f"a row breaks the constraints of {definition.name}")

    def update(self, name: str, changes: dict[str, Column], condition: Column | None) -> int:
        old = self.version(name)
        df = self.df(name)
        changes = {old.definition.column(c).name: v for c, v in changes.items()}
        hit = df if condition is None else df.filter(condition)
        count = hit.count()
        if count:
            path = self._write(name, R.update(df, changes, condition))
            staged = self.spark.read.schema(old.definition.schema).parquet(path)
            try:
                self._check(old.definition, staged)
                for key in [old.definition.key, *([c.name] for c in old.definition.columns if c.unique)]:
                    if key and set(key) & set(changes) and not staged.groupBy(*key).count().filter("count > 1").isEmpty():
                        raise ConstraintError(f"duplicate key {', '.join(key)} in {name}")
            except ConstraintError:
                self._discard(path)
                raise
            self._change("UPDATE", name, R.update(hit, changes, None))
            self.tables[name.lower()] = replace(old, parts=(path,), number=old.number + 1)
            self.refresh(name)
            self._publish()
        return count

    def delete(self, name: str, condition: Column | None) -> int:
        old = self.version(name)
        df = self.df(name)
        hit = df if condition is None else df.filter(condition)
        count = hit.count()
        if count:
            self._change("DELETE", name, hit)
            self._replace(name, R.delete(df, condition), old.definition)
        return count

    # ---- transactions

    def begin(self) -> None:
        if self._saved is not None:
            raise CatalogError("a transaction is active")
        self._saved = dict(self.tables)

    def commit(self) -> None:
        if self._saved is None:
            raise CatalogError("no transaction is active")
        self._saved = None
        self._publish()

    def rollback(self) -> None:
        if self._saved is None:
            raise CatalogError("no transaction is active")
        for name in set(self.tables) - set(self._saved):
            self.spark.catalog.dropTempView(name)
        self.tables, self._saved = self._saved, None
        self._pending = []
        for name in self.tables:
            self.refresh(name)

    # ---- snapshots

    def describe(self, name: str) -> DataFrame:
        rows = [(c.name, c.meta.get("sql_type", c.kind.simpleString().upper()), "PRI" if c.primary_key else "UNI" if c.unique else "", "NO" if c.not_null or c.primary_key else "YES", c.default) for c in self.version(name).definition.columns]
        return self.spark.createDataFrame(rows, "column_name string, type string, key string, nullable string, default_value string")

    def save(self, path: str, *, since: dict[str, int] | None = None) -> dict[str, int]:
        """Write tables, or only those changed since the given versions; returns the versions."""
        manifest = {}
        for name, v in self.tables.items():
            stored = since is None or since.get(name) != v.number
            if stored:
                self.df(name).write.mode("overwrite").parquet(f"{path}/{name}")
            manifest[name] = {"version": v.number, "stored": stored, "ddl": ddl(v.definition)}
        self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
        return {name: v.number for name, v in self.tables.items()}

    def restore(self, path: str) -> None:
        """Take the stored tables of a full or incremental snapshot; tables that it lacks go."""
        from .plans.dialect import table_definition

        manifest = json.loads(self.spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])
        for name in set(self.tables) - set(manifest):
            self.drop_table(name)
        for name, entry in manifest.items():
            if entry["stored"]:
                definition = table_definition(entry["ddl"])
                part = self._write(name, self.spark.read.schema(definition.schema).parquet(f"{path}/{name}"))
                self.tables[name] = Version(definition, (part,), entry["version"])
                self.refresh(name)
        self._publish()


def ddl(d: TableDef) -> str:
    """CREATE statement of a table."""
    parts = []
    for c in d.columns:
        metric = {"ip": " WITH DISTANCE=IP", "cosine": " WITH DISTANCE=COSINE"}.get(c.meta.get("metric", ""), "")
        parts.append(f"{c.name} {c.meta.get('sql_type', 'TEXT')}{metric}" + " NOT NULL" * c.not_null + " UNIQUE" * c.unique + " AUTO_INCREMENT" * c.auto_increment + (f" DEFAULT {c.default}" if c.default is not None else ""))
    if d.key:
        parts.append(f"PRIMARY KEY ({', '.join(d.key)})")
    return f"CREATE {'TIMESERIES ' if d.time_column else ''}TABLE {d.name} ({', '.join(parts)})"


def column(name: str, sql_type: str, **flags) -> ColumnDef:
    kind, meta = parse_type(sql_type)
    return ColumnDef(name, kind, meta, **flags)
