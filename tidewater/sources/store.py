"""A versioned table layer over Parquet: manifest, write modes, upsert, pruning, compaction, statistics.

A table is a folder with data folders and `_manifest/<version>.json`, which names the data folders
that belong to a version. A write adds a data folder and then a manifest, so a reader sees the old
version or the new one. Manifests go through Spark's file system, so any store that Spark reads
will do; the folders' Parquet files are partitioned by the table's partition columns.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("append", "overwrite", "errorifexists", "ignore")


class VersionConflict(RuntimeError):
    pass


class TableExists(RuntimeError):
    pass


@dataclass(frozen=True)
class Eq:
    """Rows whose partition column has a value."""

    column: str
    value: object


@dataclass(frozen=True)
class Between:
    """Rows whose column, of partition or data, lies between two bounds, either of which may be None."""

    column: str
    low: object = None
    high: object = None


@dataclass
class Manifest:
    version: int = 0
    folders: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    schema: str = ""


def slug(name: str) -> str:
    """A table name from any text."""
    kept = "".join(c if c.isalnum() else "_" for c in name.lower().rsplit("/", 1)[-1].removesuffix(".csv").removesuffix(".parquet"))
    return "_".join(p for p in kept.split("_") if p) or "table"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that a frame lacks is null there; the first frame that has a column sets its type."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, f.dataType)
    cast = [df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


class Store:
    """Tables of sources below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def _folder(self, source: str, table: str) -> str:
        return f"{self.root}/{source}/{table}"

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, source: str, table: str) -> Manifest | None:
        """The newest version, or None where there is no such table."""
        at = self._path(f"{self._folder(source, table)}/_manifest")
        if not self._fs.exists(at):
            return None
        versions = [s.getPath().getName() for s in self._fs.listStatus(at)]
        versions = [int(v.removesuffix(".json")) for v in versions if v.endswith(".json") and v[:-5].isdigit()]
        return Manifest(**json.loads(self._read(f"{at}/{max(versions):012d}.json"))) if versions else None

    def _commit(self, source: str, table: str, new: Manifest) -> Manifest:
        """Fails if another writer took the version.

        The manifest is written under another name and renamed without overwriting, so no reader sees half of one.
        """
        folder = f"{self._folder(source, table)}/_manifest"
        path, draft = self._path(f"{folder}/{new.version:012d}.json"), self._path(f"{folder}/_{uuid.uuid4().hex}")
        conflict = VersionConflict(f"version {new.version} of {source}/{table} is there already")
        if self._fs.exists(path):
            raise conflict
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(vars(new)).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        whole = self._fs.makeQualified(draft)
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, self._fs.makeQualified(path), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise conflict from e
            raise
        return new

    def _add(self, df: DataFrame, source: str, table: str, partition_by: list[str]) -> str:
        name = f"data-{uuid.uuid4().hex}"
        path = f"{self._folder(source, table)}/{name}"
        # A folder without partition columns in its paths is readable even when it has no rows.
        (df.write.partitionBy(*partition_by) if partition_by and not df.isEmpty() else df.write).option("compression", "zstd").parquet(path)
        return name

    # Reading

    def tables(self, source: str) -> list[str]:
        at = self._path(f"{self.root}/{source}")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(t for t in names if self.manifest(source, t))

    def read(self, source: str, table: str, at: Manifest | None = None) -> DataFrame | None:
        """All rows of the newest version, or of a given one, columns united by name; None where there is no table."""
        now = at or self.manifest(source, table)
        if now is None:
            return None
        schema = T.StructType.fromJson(json.loads(now.schema))
        frames = [self.spark.read.option("basePath", p).parquet(p) for p in (f"{self._folder(source, table)}/{f}" for f in now.folders)]
        if not frames:
            return self.spark.createDataFrame([], schema)
        out = union_by_name([self.spark.createDataFrame([], schema), *frames]) if len(frames) > 1 else frames[0]
        return out.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def scan(self, source: str, table: str, filters: list[Eq | Between] = ()) -> DataFrame | None:
        """The rows that satisfy all filters. Partition columns prune folders, others Parquet row groups, by their own types."""
        df = self.read(source, table)
        if df is None:
            return None
        for f in filters:
            c, kind = F.col(f"`{f.column}`"), df.schema[f.column].dataType
            if isinstance(f, Eq):
                df = df.where(c.eqNullSafe(F.lit(f.value).cast(kind)))
            else:
                if f.low is not None:
                    df = df.where(c >= F.lit(f.low).cast(kind))
                if f.high is not None:
                    df = df.where(c <= F.lit(f.high).cast(kind))
        return df

    def partition_values(self, source: str, table: str, column: str) -> DataFrame:
        return self.read(source, table).select(column).distinct().orderBy(column)

    # Writing

    def _next(self, source: str, table: str, df: DataFrame, folders: list[str], partition_by: list[str], keep: Manifest | None) -> Manifest:
        fields = {f.name: f for f in (T.StructType.fromJson(json.loads(keep.schema)) if keep else T.StructType([]))}
        for f in df.schema:
            fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return Manifest((keep.version if keep else 0) + 1, folders, partition_by, T.StructType(list(fields.values())).json())

    def ingest(
        self, df: DataFrame, source: str, table: str, mode: str = "append", partition_by: list[str] | None = None, expected_version: int | None = None
    ) -> Manifest | None:
        """Appends, overwrites, fails or does nothing where the table exists; an empty input is dropped, except by overwrite.

        With an expected version (0: no table) it fails unless it follows that one, whoever commits in between.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode '{mode}'")
        now = self.manifest(source, table)
        there = now.version if now else 0
        if expected_version is not None and there != expected_version:
            raise VersionConflict(f"{source}/{table} is at version {there}, not {expected_version}")
        if now and mode == "errorifexists":
            raise TableExists(f"{source}/{table}")
        if (now and mode == "ignore") or (mode != "overwrite" and df.isEmpty()):
            return now
        by = partition_by if partition_by is not None else (now.partition_by if now else [])
        old = now.folders if now and mode == "append" else []
        version = self._next(source, table, df, [*old, self._add(df, source, table, by)], by, now if mode == "append" else None)
        version.version = there + 1
        return self._commit(source, table, version)

    def write(self, df: DataFrame, source: str, table: str, partition_by: list[str] | None = None, expected_version: int | None = None) -> Manifest:
        """Creates or replaces; a frame without rows still makes a table with its columns."""
        return self.ingest(df, source, table, "overwrite", partition_by, expected_version)

    def replace(self, df: DataFrame, source: str, table: str, expected_version: int | None = None) -> Manifest:
        """Swaps all rows, if the table is still at the expected version when they are committed."""
        return self.write(df, source, table, None, expected_version)

    def merge(self, df: DataFrame, source: str, table: str, keys: list[str]) -> dict[str, int]:
        """Upsert: {rows_updated, rows_inserted}. Every row of df is kept, duplicate keys too.

        Fails if the table moved on from the version that was read.
        """
        at = self.manifest(source, table)
        if at is None:
            n = df.count()
            self.write(df, source, table, None, 0)
            return {"rows_updated": 0, "rows_inserted": n}
        now = self.read(source, table, at)
        counts = merge_counts(now, df, keys)
        self.write(merged(now, df, keys), source, table, at.partition_by, at.version)
        return counts

    def compact(self, source: str, table: str, rows_per_file: int = 5_000_000) -> int:
        """Rewrites the table's folders as one, with files of about so many rows; the number of folders that went, 0 if there was one.

        A partition of more rows than a file should have is dealt out over as many tasks as it needs files.
        """
        now = self.manifest(source, table)
        if now is None or len(now.folders) < 2:
            return 0
        df = self.read(source, table, now)
        if now.partition_by:
            by = [F.col(f"`{c}`") for c in now.partition_by]
            sizes = df.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_file)).cast("int").alias("_files"))
            names = {c: f"_p{i}" for i, c in enumerate(now.partition_by)}
            sizes = sizes.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "_files")
            same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()])
            # By content: a random salt would deal rows differently when a lost task runs again.
            plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
            salted = df.join(sizes, same, "left").withColumn("_salt", F.pmod(F.xxhash64(*plain), F.col("_files").cast("long")))
            df = salted.repartition(*by, F.col("_salt")).drop("_salt", "_files", *names.values())
        else:
            df = df.coalesce(max(1, -(-df.count() // rows_per_file)))
        self._commit(source, table, self._next(source, table, df, [self._add(df, source, table, now.partition_by)], now.partition_by, now))
        return len(now.folders)

    def delete(self, source: str, table: str | None = None) -> bool:
        return self._fs.delete(self._path(self._folder(source, table) if table else f"{self.root}/{source}"), True)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows and the existing ones whose keys don't come in."""
    if not keys:
        raise ValueError("a merge needs keys")
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return union_by_name([kept.select(*existing.columns), incoming])


def merge_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> dict[str, int]:
    """Existing rows that are replaced, and incoming rows beyond that number."""
    updated = existing.join(incoming.select(*keys), keys, "left_semi").count()
    return {"rows_updated": updated, "rows_inserted": max(0, incoming.count() - updated)}


_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _stat_columns(df: DataFrame) -> list[Column]:
    made = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        low, high = (F.min(c).cast("string"), F.max(c).cast("string")) if isinstance(f.dataType, _ORDERED) else (F.lit(None).cast("string"),) * 2
        made.append(F.struct(F.lit(f.name).alias("column"), low.alias("min"), high.alias("max"), F.count(F.when(c.isNull(), 1)).alias("null_count")))
    return made


def column_stats(df: DataFrame) -> DataFrame:
    """Rows (column, min, max, null_count), the bounds as text, null where a type has no order; one pass."""
    return df.agg(F.array(*_stat_columns(df)).alias("s")).select(F.inline("s"))


def file_stats(df: DataFrame) -> DataFrame:
    """column_stats of each file that the rows come from."""
    named = df.withColumn("_file", F.input_file_name())
    return named.groupBy(F.col("_file").alias("file")).agg(F.array(*_stat_columns(df)).alias("s")).select("file", F.inline("s"))


def load_csv(spark: SparkSession, path: str, sample: int = 1000) -> DataFrame:
    """A CSV file with a header; types are inferred from the first rows, and a later one that doesn't fit fails when it is read."""
    lines = getattr(spark.read.text(path).limit(sample + 1)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    head = DataFrame(spark.read.option("header", True).option("inferSchema", True)._jreader.csv(lines), spark)
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(head.schema).csv(path)


def upload_csv(store: Store, path: str, source: str, sample: int = 10_000) -> str:
    """A CSV file as a new table named after it; without rows, or if the table exists, it fails."""
    df = load_csv(store.spark, path, sample)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    name = slug(path)
    store.ingest(df, source, name, "errorifexists")
    return name


def sync(store: Store, source: str, table: str, fetch, keys: list[str], cursor_column: str) -> object:
    """One incremental run of a connector: fetch(cursor) gives new rows, which are merged; the new cursor is their largest value.

    Cursors are a table of their own, so a run that fails before its end is repeated from the old one.
    """
    cursors = store.read(source, "_cursors")
    at = cursors.where(F.col("table") == table).select("cursor").first() if cursors is not None else None
    rows = fetch(at[0] if at else None)
    if rows.isEmpty():
        return at[0] if at else None
    newest = rows.agg(F.max(cursor_column).cast("string")).first()[0]
    store.merge(rows, source, table, keys)
    store.merge(store.spark.createDataFrame([(table, newest)], "table string, cursor string"), source, "_cursors", ["table"])
    return newest
