"""A stored index of reference hashes for lookups by Hamming distance.

Two hashes within the threshold differ in some band by a share of it at most, two bits of 21 for a distance of eight. Either side flips half of them, so
both have some 67 variants and not one side 718. References are stored once as bucketed tables of variants, (band, bits of it with the flip,
flip, hash, reference), dealt to buckets by band and bits. A lookup makes the variants of its own hashes and deals them to the
same buckets, so references are joined where they lie: they are neither exploded nor shuffled again, however many there are. Of the variants
in which a pair meets in a band one counts: the stored side has flipped only what the lookup's flips cannot reach, and lower bits than those.
Additions are appended as further files of the same buckets; removals are rows of a small table of their own, with the number of the
step, and hide what was added before them. compact() rewrites the bands without what is hidden.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import band_edges, hamming

BANDS = "b int, v bigint, flip bigint, ref_h bigint, ref_id string, step bigint"
REMOVED = "ref_id string, step bigint"


class HammingIndex:
    """name: of the catalog's tables; root: where their files lie. threshold: the largest distance that lookups ask for."""

    def __init__(self, spark: SparkSession, name: str, root: str, threshold: int, buckets: int = 16, bands: int = 3):
        self.spark, self.name, self.root, self.threshold, self.buckets, self.bands = spark, name, root.rstrip("/"), threshold, buckets, bands
        self.stored_flips = threshold // bands // 2
        self._attach("bands", BANDS, "b, v", 0)
        self._attach("removed", REMOVED, "ref_id", 0)

    def _attach(self, what: str, columns: str, by: str, turn: int) -> None:
        """A session's catalog learns where the files are; they outlive it."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{what} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{what}-{turn}'")

    @staticmethod
    def _bits(h: str, at: int, n: int):
        return F.call_function("shiftrightunsigned", F.col(h), F.lit(at)).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))

    def _variants(self, hashes: DataFrame, h: str, flips: int) -> DataFrame:
        """Adds (b, v, flip): every band of each hash with up to `flips` flipped bits, and which these are."""
        each = []
        for i, (at, n) in enumerate(band_edges(self.bands)):
            masks = F.array(*[F.lit(sum(1 << k for k in some)).cast("bigint") for d in range(flips + 1) for some in combinations(range(n), d)])
            each.append(_flipped(masks, i, self._bits(h, at, n)))
        return hashes.withColumn("_x", F.explode(F.concat(*each))).select("*", "_x.b", "_x.v", "_x.flip").drop("_x")

    def add(self, refs: DataFrame, step: int) -> None:
        """refs: (ref_id, ref_h). step: a number larger than those before; a step that is repeated adds nothing to what lookups find."""
        known = refs.filter(F.col("ref_h").isNotNull()).select(F.col("ref_id").cast("string").alias("ref_id"), "ref_h")
        rows = self._variants(known, "ref_h", self.stored_flips).select("b", "v", "flip", "ref_h", "ref_id", F.lit(step).cast("bigint").alias("step"))
        self._append(rows, "bands", ("b", "v"))

    def remove(self, ids: DataFrame, step: int) -> None:
        """Hide what steps before this one have added for the given ref_id."""
        self._append(ids.select(F.col("ref_id").cast("string").alias("ref_id"), F.lit(step).cast("bigint").alias("step")), "removed", ("ref_id",))

    def _append(self, rows: DataFrame, what: str, by: tuple[str, ...]) -> None:
        # one file a bucket and step: rows are dealt as the buckets are
        rows.repartition(self.buckets, *by).write.mode("append").format("parquet").bucketBy(self.buckets, *by).sortBy(*by).saveAsTable(f"{self.name}_{what}")

    def _live(self, rows: DataFrame) -> DataFrame:
        last = self.spark.table(f"{self.name}_removed").groupBy("ref_id").agg(F.max("step").alias("_gone"))
        return rows.join(last, "ref_id", "left").filter(F.coalesce(F.col("step") > F.col("_gone"), F.lit(True))).drop("_gone")

    def lookup(self, queries: DataFrame, threshold: int | None = None) -> DataFrame:
        """(query columns..., ref_id, distance) within the threshold, of queries with a hash h."""
        most = self.threshold if threshold is None else threshold
        if most > self.threshold:
            raise ValueError(f"the index finds distances up to {self.threshold}")
        flips = max(0, most // self.bands - self.stored_flips)
        own = self._variants(queries.select("h").filter(F.col("h").isNotNull()).distinct(), "h", flips)
        # a pair meets once in a band: flips of the stored side are below those of a query that has made all of its own
        above = F.when(F.bit_count("flip") == flips, F.col("flip").bitwiseAND(-F.col("flip")) if flips else F.lit(1 << 62).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        own = own.select("h", "b", "v", above.alias("above"))
        once = (F.col("flip") == 0) | (F.col("flip") < F.col("above"))
        near = own.join(self.spark.table(f"{self.name}_bands").hint("merge"), ["b", "v"]).filter(once & (hamming(F.col("h"), F.col("ref_h")) <= most))
        found = self._live(near.select("h", "ref_h", "ref_id", "step")).groupBy("h", "ref_h", "ref_id").agg(F.max("step").alias("step"))
        return queries.join(found.select("h", "ref_id", hamming(F.col("h"), F.col("ref_h")).alias("distance")), "h")

    def compact(self) -> None:
        """Rewrite the bands without what is hidden or repeated, and forget the removals."""
        live = self._live(self.spark.table(f"{self.name}_bands")).groupBy("b", "v", "flip", "ref_h", "ref_id").agg(F.max("step").alias("step")).select("b", "v", "flip", "ref_h", "ref_id", "step")
        turn = 1 + max(int(self._place(w).rpartition("-")[2]) for w in ("bands", "removed"))
        live.repartition(self.buckets, "b", "v").write.format("parquet").bucketBy(self.buckets, "b", "v").sortBy("b", "v").option("path", f"{self.root}/bands-{turn}").saveAsTable(f"{self.name}_bands_new")
        self.spark.sql(f"DROP TABLE {self.name}_bands")
        self.spark.sql(f"ALTER TABLE {self.name}_bands_new RENAME TO {self.name}_bands")
        self.spark.sql(f"DROP TABLE {self.name}_removed")
        self._attach("removed", REMOVED, "ref_id", turn)

    def _place(self, what: str) -> str:
        got = self.spark.sql(f"DESCRIBE EXTENDED {self.name}_{what}").filter("col_name = 'Location'").first()
        return got["data_type"]

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for what in ("bands", "removed"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")


def _flipped(masks, band: int, bits):
    return F.transform(masks, lambda m: F.struct(F.lit(band).alias("b"), bits.bitwiseXOR(m).alias("v"), m.alias("flip")))
