"""Queries over state that is stored and kept up to date: roll-ups of streams, change logs, erasure, indexes."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analytics, graph, ops, texture
from ..operators.hash_index import HammingIndex
from ..sources import readers, segments, tables
from ..streaming import anomaly, flows, rollups
from . import views as V
from .detection import _matches
from .records import _ERASE, _in_turn
from .registry import query
from .scores import _M6, BASE, BASE_LONG, scored


def _rolled(spark, d, make, *columns):
    """The state that a stream of three batches leaves, of which the second comes twice."""
    root = readers.scratch(spark, "rollup")
    kept = make(spark, f"{root}/state")
    facts = scored(spark, d)
    if columns:
        facts = facts.select(*columns)

    def sink(batch, number):
        kept.merge(batch, number)
        if number == 1:  # as after a failure between the merge and Spark's own commit
            kept.merge(batch, number)

    parts = [facts.filter(F.col("scan_id") % 3 == k) for k in range(3)]
    flows.run_batches(_in_turn(spark, root, *parts), sink, f"{root}/cp")
    return kept.state()


@query(BASE + f"SELECT tenant_id, date_trunc('hour', ts) AS period, verdict, count(*) AS scan_count, {_M6('risk_score')} AS avg_risk_score, {_M6('duration_ms')} AS avg_duration_ms FROM scored GROUP BY ALL")
def stream_hourly_rollup(spark, d):
    """Hourly verdicts kept by a stream: partial sums of each batch merged once into the stored days that it touches."""
    return analytics.finalise(_rolled(spark, d, rollups.hourly_verdicts, "scan_id", "tenant_id", "ts", "verdict", "risk_score", "duration_ms"))


@query(BASE_LONG + f"SELECT tenant_id, date_trunc('day', ts)::TIMESTAMP AS day, tier, model, count(*) AS n, {_M6('score')} AS avg_score, {_M6('duration_ms')} AS avg_duration_ms FROM long_form GROUP BY ALL")
def stream_daily_rollup(spark, d):
    """Daily detections by tier and model, kept by a stream."""
    return analytics.detection_means(_rolled(spark, d, rollups.daily_detections))


@query(BASE + "SELECT date_trunc('month', ts)::TIMESTAMP AS period, verdict AS decision_type, count(*) AS n FROM scored GROUP BY ALL")
def stream_monthly_counters(spark, d):
    """Monthly decision counters, kept by a stream."""
    return _rolled(spark, d, rollups.monthly_decisions, "scan_id", "ts", "verdict")


_CHANGES = "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END"


@query(f"SELECT user_id, event_type, value, seq FROM (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS seq, max_by({_CHANGES}, event_id) AS op FROM events GROUP BY user_id) WHERE op <> 'delete'")
def changelog_state(spark, d):
    """The latest state of a change log that comes newest part first, with one part repeated and parts compacted between: errors delete."""
    e = V.t(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    log = e.select("user_id", "event_type", "value", F.col("event_id").alias("seq"), op.alias("op"))
    kept = tables.KeyedTable(spark, readers.scratch(spark, "changes"), T.StructType([log.schema[c] for c in ("user_id", "event_type", "value")]), ("user_id",), 8)
    part = F.col("seq") % 3
    kept.apply(log.filter(part == 2), "batch-0")
    kept.apply(log.filter(part == 1), "batch-1")
    kept.compact("compact-0")
    kept.apply(log.filter(part == 1), "batch-1")  # known: nothing happens
    kept.apply(log.filter(part < 2), "batch-2")  # brings part 1 again, among older rows
    return kept.read()


def _erased(spark, d):
    root = readers.scratch(spark, "erasure")
    s = scored(spark, d).select("scan_id", "tenant_id", "ts", "verdict", "risk_score")
    stores = {}
    for name, rows in (("verdicts", s), ("actions", V.actions(spark, d))):
        stores[name] = tables.StoredTable(spark, f"{root}/{name}", rows.schema, keys=("scan_id",), order=("scan_id",))
        stores[name].append(rows, "load")
    return stores, tables.erase(stores, s.filter("scan_id % 101 = 0").select("scan_id"), "request-1")


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS) + f"SELECT 'verdicts' AS store, scan_id, count(*) AS deleted FROM scored WHERE scan_id IN ({_ERASE}) GROUP BY scan_id UNION ALL SELECT 'actions', scan_id, count(*) FROM actions WHERE scan_id IN ({_ERASE}) GROUP BY scan_id")
def stored_erasure_log(spark, d):
    """Erasure in stored tables: only files with requested rows are rewritten."""
    return _erased(spark, d)[1]


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS) + f"SELECT scan_id, reviewer_id FROM actions WHERE scan_id NOT IN ({_ERASE})")
def stored_erasure_survivors(spark, d):
    return _erased(spark, d)[0]["actions"].read().select("scan_id", "reviewer_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (7, 11, 100)")
def indexed_lookup(spark, d):
    """Rows of some keys from a table whose files have Bloom bits of them: files that cannot hold one are not opened."""
    orders = V.t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    kept = tables.StoredTable(spark, readers.scratch(spark, "orders"), orders.schema, keys=("o_custkey",), order=("o_orderkey",))
    kept.append(orders, "load")
    return kept.lookup("o_custkey", 7, 11, 100)


@query(_matches(8))
def hamming_stored(spark, d):
    """Lookups in a stored index that grew in two steps and lost what did not belong there: references are not shuffled."""
    h = V.hashes(spark, d)
    refs = V.references(h)
    index = HammingIndex(spark, f"refs_{uuid.uuid4().hex}", readers.scratch(spark, "hamming"), 8)
    wrong = refs.select("ref_id", F.col("ref_h").bitwiseXOR(F.lit(1023).cast("bigint")).alias("ref_h"))
    index.add(wrong, 1)  # earlier hashes of the same references
    index.remove(wrong, 2)
    half = F.pmod(F.xxhash64("ref_id"), F.lit(2))
    index.add(refs.filter(half == 0), 3)
    index.add(refs.filter(half == 1), 4)
    index.add(refs.filter(half == 1), 4)  # repeated
    return index.lookup(h).select("vec_id", "ref_id", "distance")


_LINKS = """h2 AS (SELECT vec_id, h, CASE WHEN vec_id % 3 = 0 THEN vec_id * 31 % 211 END AS target, CASE WHEN vec_id % 7 = 0 THEN vec_id // 50 END AS account FROM hashes),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM h2 x JOIN h2 y ON x.vec_id <> y.vec_id AND (bit_count(xor(x.h, y.h)) <= 6 OR x.target = y.target OR x.account = y.account)),
reach(a, low) AS (SELECT vec_id, vec_id FROM h2 UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.a),
roots AS (SELECT a AS vec_id, min(low) AS root FROM reach GROUP BY a)"""


@query(V.with_(V.HASHES, _LINKS).replace("WITH", "WITH RECURSIVE", 1) + "SELECT root, count(*) AS rows, count(DISTINCT h) AS hs, count(DISTINCT target) AS targets, count(DISTINCT account) AS accounts FROM roots JOIN h2 USING (vec_id) GROUP BY root HAVING count(*) >= 3")
def wave_campaigns(spark, d):
    """Uploads that belong together by near fingerprints, a shared target or a group of accounts, over any chain of such links."""
    k = F.col("vec_id")
    rows = V.hashes(spark, d).select("vec_id", "h", F.when(k % 3 == 0, k * 31 % 211).alias("target"), F.when(k % 7 == 0, F.floor(k / 50)).alias("account"), F.timestamp_seconds(k).alias("ts"))
    path = readers.scratch(spark, "uploads")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    groups = graph.components(graph.near_links(rows, "vec_id", "h", 6), graph.shared_links(rows, "vec_id", "target"), graph.shared_links(rows, "vec_id", "account"))
    return graph.campaigns(rows, groups, "vec_id", 3, "h", "target", "account").drop("first_seen", "last_seen")


_RATES = """w AS (SELECT make_timestamp(1000 * (epoch_ms(max(ts)) - 3600000)) AS till FROM events),
c AS (SELECT user_id % 5 AS tenant_id, event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT *, sum(new) OVER (PARTITION BY tenant_id, event_type ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS k FROM
  (SELECT c.*, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY tenant_id, event_type ORDER BY window_start) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM c, w WHERE window_start + INTERVAL 6 HOUR <= till)),
s AS (SELECT *, count(*) OVER p AS windows, coalesce(sum(n) OVER p, 0) AS total, coalesce(sum(n * n) OVER p, 0) AS squares FROM g WINDOW p AS (PARTITION BY tenant_id, event_type, k ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("WITH " + _RATES + " SELECT tenant_id, event_type, window_start::TIMESTAMP AS window_start, n, windows, CASE WHEN windows * n > total THEN 'HIGH' ELSE 'LOW' END AS direction FROM s WHERE windows >= 5 AND (windows * n - total) * (windows * n - total) > 4 * (windows * squares - total * total)")
def stream_rate_anomalies(spark, d):
    """Rates by tenant and type that deviate by two standard deviations from what the stream has seen before; keyed state, which two idle days clear."""
    root = readers.scratch(spark, "rates")
    e = V.t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("tenant_id"), "event_type")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    cut = F.lit(lo + (hi - lo) / 2)
    src = _in_turn(spark, root, e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut))
    with anomaly.rocks_state(spark):
        found = anomaly.rate_anomalies(src, "ts", ["tenant_id", "event_type"], "6 hours", factor=2, idle=timedelta(days=2))
        flows.run_to_end(found, f"{root}/out", f"{root}/cp")
    return spark.read.schema("tenant_id bigint, event_type string, window_start timestamp, n bigint, windows bigint, direction string").parquet(f"{root}/out")


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type FROM events")
def topic_stream(spark, d):
    """A stream over archived segments of a topic, stopped on the way and taken up again from its checkpoint: no message is lost or repeated."""
    root = readers.scratch(spark, "topic")
    e = V.t(spark, d, "events")
    messages = e.select("user_id", "event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
    n = max(1, messages.count() // 4)
    segments.write_segments(messages, f"{root}/in", ["user_id"], "event_id", length=max(1, n // 5))
    spark.dataSource.register(segments.SegmentLog)
    for turn in range(2):
        src = spark.readStream.format("segment_log").option("maxOffsetsPerTrigger", n).option("commitPath", f"{root}/done").load(f"{root}/in")
        stop = {"seen": 0}

        def sink(batch, number, stop=stop, turn=turn):
            batch.select("partition", "offset", "key", "value").write.mode("overwrite").parquet(f"{root}/out/batch={number}")
            stop["seen"] += 1
            if turn == 0 and stop["seen"] == 2:
                raise InterruptedError("stopped on the way")  # after the write, before Spark's commit: the batch comes again

        q = src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/cp").start()
        try:
            q.processAllAvailable()
        except Exception:
            if turn:
                raise
        finally:
            q.stop()
    out = spark.read.schema("partition int, offset bigint, key string, value string").parquet(f"{root}/out")
    m = F.from_json("value", "event_id bigint, event_type string")
    return out.select("key", m.alias("m")).select("key", "m.event_id", "m.event_type")


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM events")
def topic_batch(spark, d):
    """The same topic read as a batch, from the earliest offset."""
    root = readers.scratch(spark, "topic")
    e = V.t(spark, d, "events")
    messages = e.select("user_id", "event_id", F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
    segments.write_segments(messages, root, ["user_id"], "event_id", length=1000)
    spark.dataSource.register(segments.SegmentLog)
    return spark.read.format("segment_log").load(root).select("key", F.col("value").cast("bigint").alias("event_id"))


@query("SELECT user_id % 5 AS tenant_id, count(value) AS n, true AS p50_within, true AS p99_within FROM events GROUP BY ALL")
def latency_sketch(spark, d):
    """Sketches by tenant and hour, merged by tenant: the ranks of their quantiles, counted in the rows themselves, are within the bound."""
    e = V.t(spark, d, "events").select((F.col("user_id") % 5).alias("tenant_id"), F.date_trunc("hour", "ts").alias("hour"), "value")
    path = readers.scratch(spark, "sketches")
    ops.latency_sketches(e, "value", ["tenant_id", "hour"]).write.parquet(path)
    merged = ops.merged_sketches(spark.read.parquet(path), ["tenant_id"])
    got = ops.sketch_quantile(ops.sketch_quantile(merged, 0.5, "p50"), 0.99, "p99").drop("sketch")
    at = lambda c: (F.count_if(F.col("value") < F.col(c)), F.count_if(F.col("value") <= F.col(c)))
    (l50, u50), (l99, u99) = at("p50"), at("p99")
    ranks = e.join(F.broadcast(got), "tenant_id").groupBy("tenant_id", "n").agg(l50.alias("l50"), u50.alias("u50"), l99.alias("l99"), u99.alias("u99"))
    within = lambda lo, hi, q: (F.col(lo) <= F.col("n") * (q + 0.02)) & (F.col(hi) >= F.col("n") * (q - 0.02))
    return ranks.select("tenant_id", "n", within("l50", "u50", 0.5).alias("p50_within"), within("l99", "u99", 0.99).alias("p99_within"))


_CELLS = "g AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127e0) AS INTEGER)) AS g FROM embeddings WHERE len(embedding) >= 64)"
_AT = lambda dr, dc: f"g[(r + ({dr})) * 8 + c + ({dc}) + 1]"
_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


@query(f"""WITH {_CELLS}, cell AS (SELECT vec_id, r, c, g, [{", ".join(f"CASE WHEN {_AT(a, b)} >= {_AT(0, 0)} THEN 1 ELSE 0 END" for a, b in _RING)}] AS ring FROM g, unnest(range(1, 7)) AS x(r), unnest(range(1, 7)) AS y(c)),
turns AS (SELECT vec_id, ring, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN ring[i] <> ring[i % 8 + 1] THEN 1 ELSE 0 END)) AS n FROM cell),
u AS (SELECT vec_id, CAST(sum(CASE WHEN n <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS uniform, count(DISTINCT CASE WHEN n <= 2 THEN list_sum(ring) ELSE 9 END) AS patterns FROM turns GROUP BY vec_id),
pairs AS (SELECT vec_id, CAST(sum((g[i + 1] - g[i + 2]) * (g[i + 1] - g[i + 2])) AS BIGINT) AS contrast, CAST(sum(CASE WHEN abs(g[i + 1] - g[i + 2]) <= 8 THEN 1 ELSE 0 END) AS BIGINT) AS alike FROM g, unnest(range(0, 64)) AS x(i) WHERE i % 8 < 7 GROUP BY vec_id)
SELECT vec_id, contrast / 56e0 AS contrast, alike / 56e0 AS homogeneity, uniform / 36e0 AS uniform_share, patterns FROM u JOIN pairs USING (vec_id)""")
def skin_texture(spark, d):
    """Local binary patterns and neighbours' differences of luminance grids, with array functions."""
    return texture.skin_texture(_grids(spark, d), "g").select("vec_id", "contrast", "homogeneity", "uniform_share", "patterns")


def _grids(spark, d):
    lum = F.transform(F.slice("embedding", 1, 64), lambda x: F.floor((x.cast("double") + 1.0) * 127.0).cast("int"))
    return V.t(spark, d, "embeddings").filter(F.size("embedding") >= 64).select("vec_id", lum.alias("g"))


@query(f"""WITH {_CELLS}, m AS (SELECT vec_id // 2 AS face_id, vec_id % 2 AS side, g, list_max(g) AS top FROM g),
spot AS (SELECT face_id, side, count(*) AS n, CAST(sum(i % 8) AS BIGINT) AS x, CAST(sum(i // 8) AS BIGINT) AS y FROM m, unnest(range(0, 64)) AS u(i) WHERE g[i + 1] * 10 >= top * 9 GROUP BY face_id, side),
twin AS (SELECT l.face_id, l.n AS left_cells, r.n AS right_cells, abs(l.x / CAST(l.n AS DOUBLE) - r.x / CAST(r.n AS DOUBLE)) AS dx, abs(l.y / CAST(l.n AS DOUBLE) - r.y / CAST(r.n AS DOUBLE)) AS dy FROM spot l JOIN spot r ON l.face_id = r.face_id AND l.side = 0 AND r.side = 1)
SELECT face_id, left_cells, right_cells, floor(sqrt(dx * dx + dy * dy) * 1e6 + 5e-1) / 1e6 AS shift, floor(least(1e0, sqrt(dx * dx + dy * dy) / 35e-1) * 1e6 + 5e-1) / 1e6 AS corneal_score FROM twin""")
def corneal_reflections(spark, d):
    """Highlights of both eyes: their centres lie alike where one light made them."""
    from ..functions.numeric import round_to

    g = _grids(spark, d).withColumn("face_id", F.floor(F.col("vec_id") / 2))
    one = lambda k, name: g.filter(F.col("vec_id") % 2 == k).select("face_id", F.col("g").alias(name))
    got = texture.corneal_reflections(one(0, "left").join(one(1, "right"), "face_id"), "left", "right")
    return got.select("face_id", "left_cells", "right_cells", round_to("shift", 6).alias("shift"), round_to("corneal_score", 6).alias("corneal_score"))
