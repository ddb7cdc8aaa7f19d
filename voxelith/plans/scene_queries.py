"""Queries on scene trees, cameras, presets and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import text as T
from voxelith.functions.vectors import Vec
from voxelith.operators import scene as N
from voxelith.operators.trees import from_root
from voxelith.plans.carriers import table
from voxelith.plans.registry import SQL, query

NODES = "SELECT s_suppkey AS node_id, CASE WHEN s_suppkey <= 1 THEN 0 ELSE s_suppkey // 3 END AS parent_id, ['mesh', 'splat', 'group', 'sprite', 'bone'][s_suppkey % 5 + 1] AS kind FROM supplier"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["mesh", "splat", "group", "sprite", "bone"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") <= 1, F.lit(0)).otherwise(F.expr("s_suppkey div 3")).alias("parent_id"), kind.alias("kind"))


@query(
    f"""WITH RECURSIVE n AS ({NODES}), t AS (
  SELECT node_id, node_id AS root, 0::BIGINT AS depth, node_id AS total FROM n WHERE parent_id = node_id OR parent_id NOT IN (SELECT node_id FROM n)
  UNION ALL SELECT n.node_id, root, depth + 1, total + n.node_id FROM t JOIN n ON n.parent_id = t.node_id AND n.parent_id <> n.node_id)
SELECT node_id, root, depth, total::BIGINT AS total FROM t"""
)
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's root, how deep it is and the sum of the ids on the way, in as many rounds as the depth's logarithm."""
    n = nodes(spark, sf_dir).withColumn("parent_id", F.nullif("parent_id", "node_id"))  # a node above itself is a root
    got = from_root(n, [], "node_id", "parent_id", F.col("node_id"), lambda above, own: above + own, "total")
    return got.select("node_id", "root", "depth", "total")


@query(
    f"""WITH RECURSIVE n AS ({NODES}), t AS (SELECT node_id, 1 AS depth FROM n WHERE parent_id = 1 UNION ALL SELECT n.node_id, depth + 1 FROM t JOIN n ON n.parent_id = t.node_id)
SELECT depth, count(*) AS n FROM t JOIN n USING (node_id) WHERE kind IN ('mesh', 'splat', 'sprite', 'points', 'line') GROUP BY depth"""
)
def scene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return N.descendants(n, 1).join(n, "node_id").where(N.is_drawn(F.col("kind"))).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT p_partkey, p_brand, CASE WHEN contains(lower(p_type), 'steel') THEN 1 WHEN NOT contains(lower(p_type), 'brass') THEN 2 END AS tier,
  contains(lower(p_type), 'steel') AS s FROM part), n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 AND p_brand < 'Brand#3' THEN 1 WHEN p_partkey % 2 = 0 THEN 2 END AS tier FROM t),
m AS (SELECT *, min(tier) OVER (PARTITION BY p_brand) AS best FROM n) SELECT p_partkey, p_brand FROM m WHERE tier = best"""
)
def body_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when((F.col("p_partkey") % 9 == 0) & (F.col("p_brand") < "Brand#3"), "Arm_Surface").when(F.col("p_partkey") % 2 == 0, "Body").otherwise("left_JOINT")
    return N.body_nodes(table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name")), "p_brand", "name").select("p_partkey", "p_brand")


@query(
    """WITH c AS (SELECT p_brand AS model, p_partkey AS ordinal, ['Idle_01', 'WalkCycle', 'RunFast', 'jump', 'sprint_b'][p_partkey % 7 + 1] AS clip FROM part),
w(action, rank, pattern) AS (VALUES ('Sprint', 0, 'sprint'), ('Sprint', 1, 'run'), ('Sprint', 2, 'walk'), ('Idle', 0, 'idle'), ('Fall', 0, 'fall'), ('Fall', 1, 'jump')),
r AS (SELECT *, row_number() OVER (PARTITION BY model, action ORDER BY rank, ordinal) AS n FROM c JOIN w ON contains(lower(clip), pattern))
SELECT model, action, clip FROM r WHERE n = 1"""
)
def clip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.get(F.array(*map(F.lit, ["Idle_01", "WalkCycle", "RunFast", "jump", "sprint_b"])), (F.col("p_partkey") % 7).cast("int"))
    clips = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("ordinal"), clip.alias("clip"))
    wanted = [("Sprint", 0, "sprint"), ("Sprint", 1, "run"), ("Sprint", 2, "walk"), ("Idle", 0, "idle"), ("Fall", 0, "fall"), ("Fall", 1, "jump")]
    return N.find_clips(clips, spark.createDataFrame(wanted, "action string, rank int, pattern string"))


@query(
    """SELECT n_nationkey, 0::DOUBLE AS up_x, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END::DOUBLE AS up_y, CASE n_nationkey % 4 WHEN 0 THEN 1 ELSE 0 END::DOUBLE AS up_z,
  CASE n_nationkey % 4 WHEN 0 THEN -3 WHEN 1 THEN 1.2 ELSE -1.2 END::DOUBLE AS at_y, CASE n_nationkey % 4 WHEN 0 THEN 1.2 ELSE 3 END::DOUBLE AS at_z FROM nation"""
)
def axis_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["z-up", "opengl", "opencv", "none"])), F.col("n_nationkey") % 4 + 1)
    rows = N.with_axes(table(spark, sf_dir, "nation").withColumn("preset", name), "preset")
    return rows.select("n_nationkey", *(F.col(f"up.{a}").alias(f"up_{a}") for a in "xyz"), F.col("position.y").alias("at_y"), F.col("position.z").alias("at_z"))


@query(
    """WITH f AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1600 END AS w, 900 + event_id % 3 AS h FROM events), a AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w / h ELSE 1.0 END AS aspect FROM f),
l AS (SELECT *, lag(aspect) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM a) SELECT user_id, event_id, aspect FROM l WHERE was IS NULL OR abs(aspect - was) > 0.001"""
)
def aspect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, 0).otherwise(1600).alias("width"), (900 + F.col("event_id") % 3).alias("height"))
    return N.aspect_changes(f, "user_id", "event_id").select("user_id", "event_id", "aspect")


@query(
    """WITH e AS (SELECT event_id, value AS az, greatest(-1.3962634015954636, least(1.2217304763960306, value / 30 - 1.5)) AS el FROM events)
SELECT event_id, round(1 + 4.5 * sin(az) * cos(el), 6) AS x, round(2 + 4.5 * sin(el), 6) AS y, round(3 + 4.5 * cos(az) * cos(el), 6) AS z FROM e"""
)
def third_person_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = N.third_person(Vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("value"), F.col("value") / 30 - 1.5, 4.5)
    return table(spark, sf_dir, "events").select("event_id", *(F.round(c, 6).alias(a) for c, a in zip(at, "xyz")))


@query("SELECT event_id, value AS fov, user_id::DOUBLE AS x FROM events WHERE event_id % 5 > 0")
def pose_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses as JSON and back; texts without a rotation give none."""
    v = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    turn = F.when(F.col("event_id") % 5 > 0, F.struct(F.lit(0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit("XYZ").alias("order")))
    pose = F.struct(v(F.col("user_id").cast("double")).alias("position"), turn.alias("rotation"), v(F.lit(0.0)).alias("up"), F.col("value").alias("fov"), F.lit(0.1).alias("near"), F.lit(99.0).alias("far"))
    back = table(spark, sf_dir, "events").select("event_id", N.pose_of(N.pose_json(pose)).alias("p")).where("p IS NOT NULL")
    return back.select("event_id", F.col("p.fov").alias("fov"), F.col("p.position.x").alias("x"))


@query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0.5 WHEN 'MACHINERY' THEN 2.0 ELSE c_acctbal END::DOUBLE AS lod, CASE c_mktsegment WHEN 'BUILDING' THEN 'low' ELSE 'own' END AS quality FROM customer"""
)
def preset_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("BUILDING", 0.5, "low"), ("MACHINERY", 2.0, None)], "c_mktsegment string, lod double, quality string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("lod"), F.lit("own").alias("quality"))
    return N.with_preset(rows, p, "c_mktsegment", ["lod", "quality"]).select("c_custkey", "lod", "quality")


@query("SELECT n_nationkey, n_nationkey % 3 <> 1 AS inside FROM nation")
def path_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ["/srv/docs/a.md", "/srv/docs-old/a.md", "/srv/docs"])), F.col("n_nationkey") % 3 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", N.inside(F.lit("/srv/docs/"), path).alias("inside"))


@query(
    """SELECT p_partkey, list_filter([CASE WHEN p_size % 7 = 0 THEN 'order' END, CASE WHEN p_size % 5 = 0 THEN 'surfaces' END, CASE WHEN p_size % 3 = 0 THEN 'accent' END, CASE WHEN p_size % 4 = 0 THEN 'title' END], lambda x: x IS NOT NULL) AS problems FROM part"""
)
def example_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(n % 7 == 0, -1).otherwise(n).alias("order"),
        F.when(n % 5 == 0, F.array(F.lit("examples"), F.lit("examples"))).otherwise(F.array(F.lit("playground"))).alias("surfaces"),
        F.array(F.lit("lod")).alias("tags"),
        F.when(n % 3 == 0, "#12345").otherwise("#a1B2c3").alias("accent"),
        F.lit(" /cover.png ").alias("coverImageUrl"),
        F.when(n % 4 == 0, F.create_map(F.lit("en-US"), F.lit("t"))).otherwise(F.create_map(F.lit("en-US"), F.lit("t"), F.lit("zh-CN"), F.lit("u"))).alias("title"),
    )
    return N.example_problems(rows).select("p_partkey", "problems")


@query("SELECT range AS vertex, round(-2 * cos(range % 25 / 24 * 2 * pi()) * sin(range // 25 / 12 * pi()), 6) + 0.0 AS x, round(2 * cos(range // 25 / 12 * pi()), 6) + 0.0 AS y, round(2 * sin(range % 25 / 24 * 2 * pi()) * sin(range // 25 / 12 * pi()), 6) + 0.0 AS z FROM range(325)")
def sphere_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = N.sphere_grid(spark, 2.0, 12, 24)
    return g.select("vertex", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"))


@query("SELECT user_id, count(*) FILTER (event_id % 4 = 0) AS failed, count(*) AS n FROM events GROUP BY user_id")
def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source for each event."""
    return _imported(table(spark, sf_dir, "events"))


def _imported(events: DataFrame) -> DataFrame:
    """Every fourth source is broken; the others are loaded all the same."""

    def load(name: str, content: bytes) -> int:
        if len(content) % 2:
            raise ValueError("odd")
        return len(content)

    e = events.withColumn("content", F.when(F.col("event_id") % 4 == 0, F.lit("abc")).otherwise(F.lit("ab")).cast("binary"))
    got = N.import_all(e.withColumn("name", F.concat_ws("/", "user_id", "event_id")), load)
    return got.groupBy(F.split("name", "/")[0].cast("bigint").alias("user_id")).agg(F.count_if(F.col("status") == "error").alias("failed"), F.count(F.lit(1)).alias("n"))


@query(SQL["import_records"])
def import_records_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as import_records, which had fewer events once."""
    return import_records(spark, sf_dir)


@query("SELECT page_id, list_filter(regexp_split_to_array(' ' || url || ', b.ply' || chr(10) || 'c', '[\\s,]+'), lambda x: x <> '') AS urls, regexp_matches(url, '\\.json$') AS is_json FROM pages")
def pasted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pasted = F.concat(F.lit(" "), "url", F.lit(", b.ply\nc"))
    return table(spark, sf_dir, "pages").select("page_id", T.split_urls(pasted).alias("urls"), (T.extension(F.col("url")) == ".json").alias("is_json"))


@query(
    """SELECT range AS vertex, round((3 + 0.5 * cos(v)) * cos(u), 6) + 0.0 AS x, round((3 + 0.5 * cos(v)) * sin(u), 6) + 0.0 AS y, round(0.5 * sin(v), 6) + 0.0 AS z
FROM (SELECT range, range // 17 / 8 * 2 * pi() AS v, range % 17 / 16 * 2 * pi() AS u FROM range(153))"""
)
def torus_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = N.torus_grid(spark, 3.0, 0.5, 8, 16)
    return g.select("vertex", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"))


@query(
    """WITH p AS (SELECT user_id, event_id, value AS x0, (event_id % 7)::DOUBLE AS y0, value * 2 AS x1, (event_id % 11)::DOUBLE AS y1 FROM events),
m AS (SELECT user_id, event_id, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS d FROM p),
l AS (SELECT user_id, event_id, mx - lag(mx) OVER w AS px, my - lag(my) OVER w AS py, d - lag(d) OVER w AS dd FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(px, 6) AS pan_x, round(py, 6) AS pan_y, round(CASE WHEN abs(dd) > 0.001 THEN dd WHEN dd IS NOT NULL THEN 0 END, 6) AS dolly FROM l"""
)
def pinch_gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fingers per event: the move of their middle and the change of their distance."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    p = e.select("user_id", "event_id", v.alias("x0"), (F.col("event_id") % 7).cast("double").alias("y0"), (v * 2).alias("x1"), (F.col("event_id") % 11).cast("double").alias("y1"))
    return N.pinch(p, "user_id", "event_id").select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("pan_x", "pan_y", "dolly")))


@query(
    """WITH k AS (SELECT event_id, value * 0.016::DOUBLE AS reach, event_id % 3 - 1 AS x, event_id % 5 % 3 - 1 AS z FROM events)
SELECT event_id, round(x * reach / greatest(1, sqrt(x * x + z * z)), 6) + 0.0 AS x, round(z * reach / greatest(1, sqrt(x * x + z * z)), 6) + 0.0 AS z FROM k"""
)
def key_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of held keys, no faster along diagonals."""
    axis = Vec((F.col("event_id") % 3 - 1).cast("double"), F.lit(0.0), (F.col("event_id") % 5 % 3 - 1).cast("double"))
    move = N.key_move(axis, F.col("value"), F.lit(0.016))
    return table(spark, sf_dir, "events").select("event_id", *((F.round(c, 6) + F.lit(0.0)).alias(a) for a, c in (("x", move.x), ("z", move.z))))
