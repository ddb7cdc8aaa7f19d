"""Queries on the event stream, as batches over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import vectors as X
from voxelith.ordering import in_groups, with_neighbours
from voxelith.plans.carriers import table
from voxelith.plans.registry import query
from voxelith.streaming import folds as S
from voxelith.streaming import scans as A
from voxelith.streaming import windows as W


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")) / 1000)


#: Events numbered per user, with the time since the one before.
NUMBERED = """e AS (SELECT user_id, event_id, ts, value, event_type, epoch_us(ts) / 1000 AS ms, row_number() OVER w AS n,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000, 0) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = with_neighbours(e, ["user_id"], [F.col("event_id")], ["us"])
    return e.withColumn("dt", F.coalesce((F.col("us") - F.col("prev.us")) / 1000000, F.lit(0.0))).drop("us", "prev", "next")


@query(
    f"""WITH RECURSIVE {NUMBERED}, r AS (
  SELECT user_id, event_id, n, ms AS last, ms AS shown_at, 0.0::DOUBLE AS fps, 0.0::DOUBLE AS shown FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.ms, CASE WHEN e.ms - shown_at >= 250 THEN e.ms ELSE shown_at END, f.f, CASE WHEN e.ms - shown_at >= 250 THEN floor(f.f + 0.5) ELSE shown END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT CASE WHEN r.fps = 0 THEN 1000 / greatest(1, e.ms - r.last) ELSE r.fps + (1000 / greatest(1, e.ms - r.last) - r.fps) * 0.08::DOUBLE END AS f) f)
SELECT user_id, event_id, round(fps, 9) AS fps, shown FROM r"""
)
def ewma_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, step, out, _ = S.fps()
    return S.fold(events(spark, sf_dir), "user_id", ["event_id"], ["ms"], start, step, out).withColumn("fps", F.round("fps", 9))


@query(
    f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS target FROM e), r AS (
  SELECT user_id, event_id, n, target AS v FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.n, CASE WHEN t.target IS NULL THEN NULL WHEN r.v IS NULL THEN t.target
    ELSE r.v + (t.target - r.v) * (1 - exp(-greatest(0, t.dt) * CASE WHEN t.target < r.v THEN 0.014::DOUBLE ELSE 0.007::DOUBLE END)) END
  FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, round(v, 6) AS smoothed FROM r"""
)
def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).withColumn("target", F.when(F.col("event_type") != "error", F.col("value")))
    start, step, out, _ = S.approach(0.014, 0.007)
    return S.fold(rows, "user_id", ["event_id"], ["dt", "target"], start, step, out).withColumn("smoothed", F.round("smoothed", 6))


@query(
    f"""WITH RECURSIVE {NUMBERED}, r AS (
  SELECT user_id, event_id, n, ms AS last, 0.0::DOUBLE AS fps FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.ms, CASE WHEN r.n = 1 THEN 1000 / greatest(1, e.ms - r.last) ELSE r.fps + (1000 / greatest(1, e.ms - r.last) - r.fps) * 0.08::DOUBLE END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, round(fps, 9) AS fps FROM r"""
)
def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of ewma_fps as a composition of affine maps; a user's first rate resets it."""
    e = with_neighbours(events(spark, sf_dir).select("user_id", "event_id", "ms"), ["user_id"], [F.col("event_id")], ["ms"])
    now = F.when(F.col("prev").isNotNull(), 1000 / F.greatest(F.lit(1.0), F.col("ms") - F.col("prev.ms")))
    e = with_neighbours(e.select("user_id", "event_id", now.alias("now")), ["user_id"], [F.col("event_id")], ["now"])
    gain = F.when(F.col("now").isNull() | F.col("prev.now").isNull(), F.lit(0.0)).otherwise(F.lit(1 - 0.08))
    shift = F.when(F.col("now").isNull(), F.lit(0.0)).when(F.col("prev.now").isNull(), F.col("now")).otherwise(F.col("now") * 0.08)
    got = A.affine(e.select("user_id", "event_id", gain.alias("gain"), shift.alias("shift")), ["user_id"], [F.col("event_id")], F.col("gain"), F.col("shift"), "fps")
    return got.select("user_id", "event_id", F.round("fps", 9).alias("fps"))


@query(
    f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS target FROM e), r AS (
  SELECT user_id, event_id, n, target AS v FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.n, CASE WHEN t.target IS NULL THEN NULL WHEN r.v IS NULL THEN t.target ELSE r.v + (t.target - r.v) * (1 - exp(-greatest(0, t.dt) * 0.014::DOUBLE)) END
  FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, round(v, 6) AS smoothed FROM r"""
)
def smoothed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that follow their targets at one rate, taken anew after errors."""
    rows = timed(spark, sf_dir).withColumn("target", F.when(F.col("event_type") != "error", F.col("value"))).select("user_id", "event_id", "dt", "target")
    got = A.follow(rows, ["user_id"], [F.col("event_id")], F.col("target"), F.col("dt"), 0.014, "smoothed")
    return got.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query(
    f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, sin(value / 200) AS s, cos(value / 200) AS c FROM e), r AS (
  SELECT user_id, event_id, n, s AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, c AS w FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.n,
    CASE WHEN t.n % 2 = 1 THEN r.w * s + r.x * c ELSE r.x * c - r.z * s END, CASE WHEN t.n % 2 = 1 THEN r.y * c + r.z * s ELSE r.w * s + r.y * c END,
    CASE WHEN t.n % 2 = 1 THEN r.z * c - r.y * s ELSE r.z * c + r.x * s END, CASE WHEN t.n % 2 = 1 THEN r.w * c - r.x * s ELSE r.w * c - r.y * s END
  FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(w, 9) AS w FROM r"""
)
def camera_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations of each user's camera after turns about its own x and y axes in turn."""
    e = in_groups(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("event_id")], unique=True)
    turn = {"qx": F.when(F.col("place") % 2 == 0, F.sin(F.col("value") / 200)).otherwise(0.0), "qy": F.when(F.col("place") % 2 == 1, F.sin(F.col("value") / 200)).otherwise(0.0), "qz": F.lit(0.0), "qw": F.cos(F.col("value") / 200)}
    got = A.orientations(e.select("user_id", "event_id", *(v.alias(k) for k, v in turn.items())), ["user_id"], [F.col("event_id")])
    return got.select("user_id", "event_id", *((F.round(f"q.{k}", 9) + F.lit(0.0)).alias(k) for k in "xyzw"))


@query(
    f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, value / 100 AS speed, event_type <> 'view' AS grounded, value / 10 - 3 AS vertical FROM e), r AS (
  SELECT user_id, event_id, n, CASE WHEN NOT grounded AND speed < 0.12 AND vertical <= -0.85 THEN 'Idle' WHEN speed > 0.12 THEN 'Walk' ELSE 'Idle' END AS mode,
    NOT grounded AND speed < 0.12 AND vertical <= -0.85 AS falls FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.n, CASE WHEN NOT t.grounded AND t.speed < 0.12 AND t.vertical <= -0.85 THEN mode
      WHEN mode = 'Walk' THEN CASE WHEN t.speed < 0.05 THEN 'Idle' ELSE 'Walk' END WHEN t.speed > 0.12 THEN 'Walk' ELSE mode END,
    NOT t.grounded AND t.speed < 0.12 AND t.vertical <= -0.85 FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, CASE WHEN falls THEN 'Fall' ELSE mode END AS action FROM r"""
)
def locomotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("speed"), (F.col("event_type") != "view").alias("grounded"), (F.col("value") / 10 - 3).alias("vertical"))
    start, step, out, _ = S.locomotion()
    return S.fold(rows, "user_id", ["event_id"], ["speed", "grounded", "vertical"], start, step, out)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, greatest(0::DOUBLE, least(0.05::DOUBLE, value / 1000)) AS dt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), z AS (
  SELECT user_id, event_id, n, list_reduce(list_transform(range(12), lambda i: {'k': 0, 'o': least(dt, 10 * (1 / 60::DOUBLE))}),
    lambda a, x: CASE WHEN a.o >= 1 / 60::DOUBLE THEN {'k': a.k + 1, 'o': a.o - 1 / 60::DOUBLE} ELSE a END) AS s FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, list_reduce(list_transform(range(12), lambda i: {'k': 0, 'o': least(z.s.o + e.dt, 10 * (1 / 60::DOUBLE))}),
    lambda a, x: CASE WHEN a.o >= 1 / 60::DOUBLE THEN {'k': a.k + 1, 'o': a.o - 1 / 60::DOUBLE} ELSE a END) FROM z JOIN e ON e.user_id = z.user_id AND e.n = z.n + 1)
SELECT user_id, event_id, s.k::INT AS steps, round(s.o, 9) AS owed FROM z"""
)
def fixed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, step, out, _ = S.fixed_steps()
    return S.fold(table(spark, sf_dir, "events").withColumn("dt", F.col("value") / 1000), "user_id", ["event_id"], ["dt"], start, step, out).withColumn("owed", F.round("owed", 9))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value / 50 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (
  SELECT user_id, event_id, n, t AS y, 0::DOUBLE AS s, true AS grounded FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN r.y - e.t > 0.1::DOUBLE AND r.y + v.f * (1 / 60::DOUBLE) <= e.t THEN e.t WHEN r.y - e.t > 0.1::DOUBLE THEN r.y + v.f * (1 / 60::DOUBLE) ELSE r.y + v.g * (1 / 60::DOUBLE) END,
    CASE WHEN r.y - e.t > 0.1::DOUBLE AND r.y + v.f * (1 / 60::DOUBLE) <= e.t THEN 0 WHEN r.y - e.t > 0.1::DOUBLE THEN v.f ELSE v.g END, r.y - e.t <= 0.1::DOUBLE
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT r.s - 9.8::DOUBLE * (1 / 60::DOUBLE) AS f, r.s + (-120::DOUBLE * (r.y - e.t) - 14::DOUBLE * r.s) * (1 / 60::DOUBLE) AS g) v)
SELECT user_id, event_id, round(y, 6) AS height, round(s, 6) AS speed, grounded FROM r"""
)
def spring_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, step, out, _ = S.spring()
    rows = table(spark, sf_dir, "events").withColumn("dt", F.lit(1 / 60)).withColumn("target", F.col("value") / 50)
    got = S.fold(rows, "user_id", ["event_id"], ["dt", "target"], start, step, out)
    return got.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("height", "speed")})


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS at, count(*) AS n, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "value", ["event_id"])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, value FROM events), s AS (
  SELECT a.user_id, a.us, min(b.us) AS following FROM (SELECT DISTINCT user_id, us FROM e) a LEFT JOIN e b ON a.user_id = b.user_id AND b.us >= a.us + 43200000000 GROUP BY ALL
), c AS (SELECT user_id, min(us) AS start FROM e GROUP BY user_id UNION ALL SELECT c.user_id, s.following FROM c JOIN s ON c.user_id = s.user_id AND c.start = s.us WHERE s.following IS NOT NULL
), w AS (SELECT e.*, (SELECT max(start) FROM c WHERE c.user_id = e.user_id AND c.start <= e.us) AS start FROM e)
SELECT user_id, start, count(*) AS n, arg_max(value, us::HUGEINT * 1000000000 + event_id) AS value FROM w GROUP BY user_id, start"""
)
def throttled_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttling by windows of 12 hours that begin with the first event after the last window."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    return W.throttle_from_first(e, "user_id", "us", 43_200_000_000, "value", ["event_id"])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, burst"""
)
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "8 hours")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS at, count(*) AS frames, floor(count(*) * 60000000.0 / 3600000 + 0.5)::BIGINT AS rate FROM events GROUP BY 1")
def refresh_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per minute and hour of the stream, rounded: the same estimate as frames per second."""
    return W.rate(table(spark, sf_dir, "events"), "ts", "1 hour", per_ms=60_000_000.0)


@query("SELECT event_id, user_id, value FROM events e WHERE floor(value)::BIGINT % 10 = (SELECT max(floor(value)::BIGINT % 10) FROM events f WHERE f.user_id = e.user_id)")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("g", F.floor("value").cast("bigint") % 10)
    return W.current_generation(e, "user_id", "g").select("event_id", "user_id", "value")


@query("SELECT event_id FROM events WHERE event_type = 'click' OR value > 50 OR user_id % 10 = 3")
def dirty_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rendered(table(spark, sf_dir, "events"), [F.col("event_type") == "click", F.col("value") > 50, F.col("user_id") % 10 == 3]).select("event_id")


@query(
    """WITH c AS (SELECT c_custkey % 80 AS k, max(c_custkey) AS value, max(c_custkey) % 3 AS version FROM customer WHERE c_custkey % 80 < 60 GROUP BY 1)
SELECT event_id, coalesce(e.want IS NULL OR e.want = c.version, false) AND c.k IS NOT NULL AS hit, CASE WHEN c.k IS NOT NULL AND (e.want IS NULL OR e.want = c.version) THEN c.value END AS value
FROM (SELECT event_id, user_id % 80 AS k, CASE WHEN event_id % 2 = 0 THEN event_id % 3 END AS want FROM events) e LEFT JOIN c ON e.k = c.k"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 80).where("k < 60").groupBy("k").agg(F.max("c_custkey").alias("value"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 80).alias("k"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3).alias("want"))
    return W.cached(e, c.withColumn("version", F.col("value") % 3), "k", "want").select("event_id", "hit", "value")


@query(
    """WITH p AS (SELECT user_id, event_id, value / 100 AS x, cos(value / 400) AS fx, sin(value / 400) AS fy FROM events),
l AS (SELECT *, lag(x) OVER w AS px, lag(fx) OVER w AS pfx, lag(fy) OVER w AS pfy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, coalesce(pow(x - px, 2) > 0.1::DOUBLE * 0.1::DOUBLE OR fx * pfx + fy * pfy < 0.99999, true) AS resort FROM l"""
)
def resort_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    p = table(spark, sf_dir, "events").select("user_id", "event_id", (v / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.cos(v / 400).alias("fx"), F.sin(v / 400).alias("fy"), F.lit(0.0).alias("fz"))
    return W.resorts(p, "user_id", ["event_id"]).select("user_id", "event_id", "resort")


@query(
    """SELECT event_id, round(atan2(sin(value), cos(value)), 9) AS angle, CASE WHEN user_id % 2 = 0 THEN 10.0 ELSE 1.0 END * CASE WHEN user_id % 3 = 0 THEN 2.0 ELSE 1.0 END * CASE WHEN user_id % 5 = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS speed,
  CASE WHEN event_id % 3 IN (1, 2) THEN 'pan' WHEN user_id % 2 = 0 THEN 'orbit' ELSE 'rotate' END AS pointer, greatest(0.35, least(0.8, value / 50)) AS walk_pace FROM events"""
)
def control_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped angles, speed factors of held keys (shift 10, ctrl 2, caps 20), pointer modes and animation pace."""
    held = lambda n, f: F.when(F.col("user_id") % n == 0, F.lit(f)).otherwise(F.lit(1.0))
    pointer = F.when((F.col("event_id") % 3).isin(1, 2), "pan").when(F.col("user_id") % 2 == 0, "orbit").otherwise("rotate")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(X.wrap_angle(F.col("value")), 9).alias("angle"), (held(2, 10.0) * held(3, 2.0) * held(5, 20.0)).alias("speed"), pointer.alias("pointer"), X.clamp(F.col("value") / 50, 0.35, 0.8).alias("walk_pace")
    )


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (
  SELECT user_id, event_id, n, event_type AS action, NULL::VARCHAR AS before, 0.18::DOUBLE AS since FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.event_type, CASE WHEN e.event_type <> r.action THEN r.action ELSE r.before END, CASE WHEN e.event_type <> r.action THEN 0::DOUBLE ELSE r.since + 0.07::DOUBLE END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, action, round(least(1, since / 0.18::DOUBLE), 9) AS weight, CASE WHEN since / 0.18::DOUBLE < 1 THEN before END AS fading FROM r"""
)
def cross_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, step, out, _ = S.cross_fade()
    rows = table(spark, sf_dir, "events").withColumn("dt", F.lit(0.07))
    return S.fold(rows, "user_id", ["event_id"], ["dt", "event_type"], start, step, out).withColumn("weight", F.round("weight", 9))
