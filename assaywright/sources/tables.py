"""Stored tables that change, on any Hadoop file system: a list of files per version, of which the last finished one counts.

    root/data/<new name>/[part=<value>/]*.parquet   rows; files are never changed
    root/versions/<number>.<note>/                  a Parquet table with a line for each file of that version

A version is finished once its writer has put _SUCCESS there, so a change is seen as a whole or not at all, a failed one leaves nothing but
files that nobody reads (vacuum() takes them away), and readers of the version before go on with its files. The note says which step made
a version: a step that is repeated after a failure finds its note and does nothing. There is one writer at a time.

A line has the file's rows and, for the columns of `keys`, its smallest and largest value and Bloom bits (`buckets` * 4 kB, two positions a
key: with ten bits a key 3 % of other files are opened in vain). lookup() opens only files that can hold a key. Lines go through the
driver as file listings always do; bits do not, but for lookups, which test them in Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bucket of Spark's bitmaps.
BITS = 32768
#: Positions of a key in the Bloom bits.
POSITIONS = 2


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _bit(bits: str, at: Column) -> Column:
    """Whether the bit at a position is set in an array of bitmaps."""
    bit, bucket = F.bitmap_bit_position(at), F.bitmap_bucket_number(at)
    whole = F.get(F.filter(bits, lambda x: x["bucket"] == bucket), F.lit(0))["bits"]
    byte = F.conv(F.hex(F.substring(whole, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


class StoredTable:
    """keys: columns with an index. part: the column whose values are folders, if any. order: columns by which rows are sorted into files."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = (), part: str | None = None, order: tuple[str, ...] = (), buckets: int = 8):
        self.spark, self.root, self.schema, self.keys, self.part, self.order, self.buckets = spark, root.rstrip("/"), schema, keys, part, order, buckets

    # ---- versions
    def versions(self) -> list[str]:
        """Names of finished versions in order."""
        fs, p = _fs(self.spark, f"{self.root}/versions/*/_SUCCESS")
        return sorted(x.getPath().getParent().getName() for x in (fs.globStatus(p) or []))

    def done(self, note: str) -> bool:
        return any(v.partition(".")[2] == note for v in self.versions())

    def files(self) -> DataFrame:
        """A line for each file: path (below data), part, kind, rows, and low, high and bits of each key."""
        last = self.versions()
        lines = self._lines()
        return self.spark.read.schema(lines).parquet(f"{self.root}/versions/{last[-1]}") if last else self.spark.createDataFrame([], lines)

    def _lines(self) -> T.StructType:
        of = lambda k: self.schema[k].dataType.simpleString()
        each = [f"`low_{k}` {of(k)}, `high_{k}` {of(k)}, `bits_{k}` array<struct<bucket:bigint,bits:binary>>" for k in self.keys]
        return T.StructType.fromDDL(", ".join(["path string, part string, kind string, rows bigint", *each]))

    def commit(self, add: DataFrame | None, gone: list[str], note: str) -> None:
        """The next version: the files of the last one without `gone`, and those of `add`."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", note):
            raise ValueError("a note has letters, digits, - and _")
        names = self.versions()
        kept = self.files()
        if gone:
            kept = kept.join(F.broadcast(self.spark.createDataFrame([(g,) for g in gone], "path string")), "path", "left_anti")
        lines = kept if add is None else kept.unionByName(add)
        new = f"{int(names[-1].partition('.')[0]) + 1 if names else 1:08d}"
        fs, left = _fs(self.spark, f"{self.root}/versions/{new}.*")
        for x in fs.globStatus(left) or []:  # what a writer that failed has left
            fs.delete(x.getPath(), True)
        lines.coalesce(max(1, lines.rdd.getNumPartitions() // 8)).write.parquet(f"{self.root}/versions/{new}.{note}")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data folders that none of the last `keep` versions reads, and the lines of older versions; how many folders went."""
        names = self.versions()
        used: set[str] = set()
        for v in names[-keep:]:
            used |= {r["top"] for r in self.spark.read.parquet(f"{self.root}/versions/{v}").select(F.substring_index("path", "/", 1).alias("top")).distinct().collect()}
        n = 0
        fs, p = _fs(self.spark, f"{self.root}/data/*")
        for x in fs.globStatus(p) or []:
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)
                n += 1
        for v in names[:-keep]:  # their names stay, as they say what has been done
            lines = _fs(self.spark, f"{self.root}/versions/{v}/part-*")[1]
            for x in fs.globStatus(lines) or []:
                fs.delete(x.getPath(), True)
        return n

    # ---- rows
    def read(self, files: DataFrame | None = None) -> DataFrame:
        """All rows, or those of some of files()."""
        paths = [f"{self.root}/data/{r['path']}" for r in (self.files() if files is None else files).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        fields = [f for f in self.schema.fields if f.name != self.part]
        got = self.spark.read.schema(T.StructType(fields)).parquet(*paths)
        return got if self.part is None else self._with_part(got)

    def _with_part(self, df: DataFrame) -> DataFrame:
        """Folders of several writes lie side by side, so the part is read from the file's path."""
        value = F.regexp_extract(F.col("_metadata.file_path"), f"/{self.part}=([^/]*)/", 1).cast(self.schema[self.part].dataType)
        return df.withColumn(self.part, value).select(*self.schema.names)

    def path_of(self) -> Column:
        """The file of a row of read(), as files() has it."""
        return F.regexp_extract(F.col("_metadata.file_path"), "^.*/data/(.*)$", 1)

    def written(self, df: DataFrame, kind: str = "base") -> DataFrame:
        """Write rows to new files and return their lines; nobody reads them before they are committed."""
        name = uuid.uuid4().hex
        df = df.select(*self.schema.names)
        lead = [self.part] * (self.part is not None)
        if self.order or lead:  # by ranges, so a part with very many rows is many files
            df = df.repartitionByRange(*lead, *self.order).sortWithinPartitions(*lead, *self.order)
        out = df.write.option("compression", "zstd")
        (out.partitionBy(self.part) if self.part else out).parquet(f"{self.root}/data/{name}")
        return self._indexed(name, kind)

    def _indexed(self, name: str, kind: str) -> DataFrame:
        fields = T.StructType([f for f in self.schema.fields if f.name != self.part])
        rows = self.spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(f"{self.root}/data/{name}").select(self.path_of().alias("path"), *self.keys)
        ends = [x for k in self.keys for x in (F.min(k).alias(f"low_{k}"), F.max(k).alias(f"high_{k}"))]
        lines = rows.groupBy("path").agg(F.count("*").alias("rows"), *ends)
        for k in self.keys:
            at = rows.filter(F.col(k).isNotNull()).select("path", F.explode(F.array(*self.positions(F.col(k)))).alias("at"))
            bits = at.groupBy("path", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            lines = lines.join(bits.groupBy("path").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"bits_{k}")), "path", "left")
        part = F.regexp_extract("path", f"/{self.part}=([^/]*)/", 1) if self.part else F.lit(None).cast("string")
        return lines.withColumns({"part": part, "kind": F.lit(kind)}).select(*self._lines().names)

    def positions(self, key: Column) -> list[Column]:
        """From 1 on, as bitmaps count."""
        return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.buckets * BITS)) + 1 for i in range(POSITIONS)]

    def append(self, df: DataFrame, note: str, kind: str = "base") -> None:
        if not self.done(note):
            self.commit(self.written(df, kind), [], note)

    def rewrite(self, files: DataFrame, new: Callable[[DataFrame], DataFrame], note: str, kind: str = "base") -> list[str]:
        """Replace some files by what `new` makes of their rows; all others keep their names. Returns the files that went."""
        gone = [r["path"] for r in files.select("path").collect()]
        if not self.done(note):
            self.commit(self.written(new(self.read(files)), kind), gone, note)
        return gone

    # ---- lookups
    def holding(self, key: str, *values: object) -> DataFrame:
        """The lines of files that can hold one of the values: by smallest and largest value, then by Bloom bits."""
        kind = self.schema[key].dataType
        can = F.lit(False)
        for v in values:
            c = F.lit(v).cast(kind)
            inside = c.between(F.col(f"low_{key}"), F.col(f"high_{key}"))
            for at in self.positions(c):
                inside = inside & _bit(f"bits_{key}", at)
            can = can | inside
        return self.files().filter(can)

    def lookup(self, key: str, *values: object) -> DataFrame:
        """Rows of the given keys; only files that can hold one are opened."""
        return self.read(self.holding(key, *values)).filter(F.col(key).isin(*values))


# ---- erasure
def erase(tables: dict[str, StoredTable], requests: DataFrame, request: str, key: str = "scan_id") -> DataFrame:
    """Take the requested keys out of all tables: (store, key, deleted), one line for each store and key that had rows.

    Of each table only the key column is read to find the files with requested rows, which are rewritten without them; all others keep
    their names. The log is written before a table changes, and the change is one new version with the request as its note: after a
    failure the same call goes on where it stopped, and repeated calls return the same log. The erased rows' files stay until vacuum().
    """
    spark = requests.sparkSession
    wanted = requests.select(key).filter(F.col(key).isNotNull()).distinct()
    log = None
    for name, t in tables.items():
        path = f"{t.root}/erasures/{request}"
        if not t.done(request):
            hit = t.read().withColumn("_path", t.path_of()).join(wanted, key, "left_semi").groupBy(key, "_path").agg(F.count("*").alias("n"))
            hit.write.mode("overwrite").parquet(path)
            touched = spark.read.parquet(path).select(F.col("_path").alias("path")).distinct()
            t.rewrite(t.files().join(touched, "path", "left_semi"), lambda rows: rows.join(wanted, key, "left_anti"), request)
        one = spark.read.schema(f"`{key}` {t.schema[key].dataType.simpleString()}, _path string, n bigint").parquet(path)
        one = one.groupBy(key).agg(F.sum("n").alias("deleted")).select(F.lit(name).alias("store"), key, "deleted")
        log = one if log is None else log.unionByName(one)
    return log


# ---- additive state
def merge_additive(t: StoredTable, new: DataFrame, keys: list[str], sums: list[str], note: str) -> None:
    """Add a batch's partial sums to a table of sums, split by t.part: only the parts that the batch has are rewritten. A note that is
    known already changes nothing, so a batch that comes again counts once."""
    if t.done(note):
        return
    new = new.groupBy(*keys).agg(*[F.sum(c).cast(t.schema[c].dataType).alias(c) for c in sums]).persist()
    try:
        parts = [str(r[0]) for r in new.select(F.col(t.part).cast("string")).distinct().collect()]  # of one batch
        old = t.files().filter(F.col("part").isin(parts)) if parts else t.files().limit(0)
        both = lambda rows: rows.unionByName(new.select(*t.schema.names)).groupBy(*keys).agg(*[F.sum(c).cast(t.schema[c].dataType).alias(c) for c in sums])
        t.rewrite(old, both, note)
    finally:
        new.unpersist()


# ---- change logs
class KeyedTable:
    """The latest state of a log of changes: rows (key..., seq, op, values...), op `upsert` or `delete`, in any order and repeated.

    Of equal keys the row with the largest seq counts (of equal seq the larger row, so repeats and ties have one result). Changes are appended
    as files of kind `delta`, dealt to parts by a hash of the key; reading merges only parts that have some. compact() merges a part's files
    into one sorted set of kind `base` and keeps the last tombstone of a key, so that an older change that comes late does not bring it back;
    tombstones below `horizon`, the seq before which no change can come any more, go.
    """

    def __init__(self, spark: SparkSession, root: str, values: T.StructType, key: tuple[str, ...], parts: int = 16):
        """values: key columns first, then the others, without seq and op."""
        self.key, self.parts, self.values = list(key), parts, values
        schema = T.StructType([*values.fields, T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("bucket", T.IntegerType())])
        self.table = StoredTable(spark, root, schema, part="bucket", order=tuple(key))

    def apply(self, changes: DataFrame, note: str) -> None:
        """Append a batch of changes, once for each note."""
        dealt = changes.select(*self.values.names, "seq", "op").withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))
        self.table.append(dealt, note, "delta")

    def _merged(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.table.schema.names if c not in self.key and c != "seq"]
        m = rows.groupBy(*self.key).agg(F.max(F.struct("seq", *rest)).alias("m"))
        return m.select(*self.key, *[F.col(f"m.{c}").alias(c) for c in ("seq", *rest)])

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """(files of parts without changes since they were compacted, files of the others)."""
        files = self.table.files()
        dirty = files.filter("kind = 'delta'").select("part").distinct()
        return files.join(dirty, "part", "left_anti"), files.join(dirty, "part", "left_semi")

    def read(self) -> DataFrame:
        """The latest state: the keys' values and seq. Parts without changes are read as they lie."""
        clean, dirty = self._split()
        rows = self.table.read(clean).unionByName(self._merged(self.table.read(dirty)))
        return rows.filter("op <> 'delete'").select(*self.values.names, "seq")

    def compact(self, note: str, horizon: int | None = None, least: int = 1) -> list[str]:
        """Merge the files of parts that have at least `least` of kind delta; the names of the files that went."""
        many = self.table.files().filter("kind = 'delta'").groupBy("part").count().filter(F.col("count") >= least)
        files = self.table.files().join(many, "part", "left_semi")

        def new(rows: DataFrame) -> DataFrame:
            merged = self._merged(rows)
            return merged if horizon is None else merged.filter((F.col("op") != "delete") | (F.col("seq") >= horizon))

        return self.table.rewrite(files, new, note)
