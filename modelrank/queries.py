"""Registered queries over the driver's tables, each with the SQL that gives its rows.

Stand-ins: ``part`` is the model catalog, ``embeddings`` the embedded dataset
(training rows are those whose id is no multiple of 5), ``orders`` and
``lineitem`` give costs and records, ``events`` jobs, ``labels`` and
``documents`` tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embedders, identity
from .functions import labels as L
from .functions import vectors as V
from .operators import filters, halving, jobs, linear, neighbours, overlay, ranking, similarity, strategies, tasks
from .plans.session import Session
from .sources import catalog as C
from .sources import readers as R
from .sources.scratch import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODELS = sorted(embedders.builtin())
READER_IDS = 4


def query(sql: str | None) -> Callable:
    """Register a function under its own name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the catalog

CATALOG_SQL = """models AS (
  SELECT '{"name":"' || p_name || '#' || CAST(p_partkey AS VARCHAR) || '","source":"' || p_brand || '"}' AS json_model,
    p_name || '#' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS BIGINT) AS image_size, p_partkey * 1000 AS num_params,
    p_brand AS source, CASE WHEN p_type = 'PROMO' THEN ['finetuned'] END AS tag, p_retailprice AS up_acc
  FROM part
)"""


def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return p.select(
        identity.json_of(name=name, source=F.col("p_brand")).alias("json_model"), name.alias("name"), F.col("p_size").cast("long").alias("image_size"), (F.col("p_partkey") * 1000).alias("num_params"),
        F.col("p_brand").alias("source"), F.when(F.col("p_type") == "PROMO", F.array(F.lit("finetuned"))).alias("tag"), F.col("p_retailprice").alias("up_acc"),
    )


def catalog_session(spark: SparkSession, d: str) -> Session:
    s = Session(spark)
    s.add_models("image_models", model_catalog(spark, d))
    return s


def restricted(name: str, statement: str, where: str, more: str = "") -> None:
    """A statement over the catalog and the SQL of its condition."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return catalog_session(spark, d).sql(statement).select("json_model", "num_params", "source")

    run.__name__ = name
    query(f"WITH {CATALOG_SQL} SELECT json_model, num_params, source FROM models {where} {more}")(run)


restricted("restrict_eq", "SELECT * FROM image_models WHERE source = 'Brand#11';", "WHERE source = 'Brand#11'")
restricted("restrict_range", "SELECT * FROM image_models WHERE num_params > 5000 AND num_params < 90000;", "WHERE num_params BETWEEN 5000 AND 90000")
restricted("restrict_between", "SELECT * FROM image_models WHERE image_size BETWEEN 10 AND 20 AND up_acc >= 905;", "WHERE image_size BETWEEN 10 AND 20 AND up_acc >= 905")
restricted("restrict_not_finetuned", "SELECT * FROM image_models WHERE NOT FINETUNED AND image_size <= 25;", "WHERE NOT list_contains(coalesce(tag, []), 'finetuned') AND image_size <= 25")
restricted("restrict_finetuned_keeps_all", "SELECT * FROM image_models WHERE FINETUNED;", "")
restricted("restrict_nested", "SELECT * FROM image_models WHERE (source = 'Brand#11' OR source = 'Brand#22') AND image_size <> 7;", "WHERE source IN ('Brand#11', 'Brand#22') AND image_size <> 7")
restricted("restrict_null", "SELECT * FROM image_models WHERE tag IS NULL AND source IS NOT NULL;", "WHERE tag IS NULL AND source IS NOT NULL")
restricted("order_column_limit", "SELECT * FROM image_models WHERE NOT FINETUNED ORDER BY num_params DESC LIMIT 10;", "WHERE NOT list_contains(coalesce(tag, []), 'finetuned')", "ORDER BY num_params DESC, json_model LIMIT 10")


@query(f"WITH {CATALOG_SQL} SELECT json_model, image_size FROM models WHERE source = 'Brand#11' AND image_size <= 30")
def json_key_filter(spark, d):
    s = Session(spark)
    s.add_models("image_models", model_catalog(spark, d).drop("source"))  # the key is then in the JSON alone
    return s.sql("SELECT json_model, image_size FROM image_models WHERE source = 'Brand#11' AND image_size < 30;")


@query(f"WITH {CATALOG_SQL} SELECT json_model, source FROM models WHERE source = 'Brand#11' UNION ALL SELECT json_model, source FROM models WHERE image_size BETWEEN 5 AND 9")
def restrict_or_union_all(spark, d):
    return catalog_session(spark, d).sql("SELECT json_model, source FROM image_models WHERE source = 'Brand#11' OR image_size BETWEEN 5 AND 9;")


@query(f"WITH {CATALOG_SQL} SELECT name, CASE WHEN image_size % 3 = 0 THEN NULL ELSE image_size END AS size FROM models WHERE CASE WHEN image_size % 3 = 0 THEN NULL ELSE image_size END BETWEEN 4 AND 30")
def restrict_null_range(spark, d):
    m = model_catalog(spark, d).select("name", F.when(F.col("image_size") % 3 != 0, F.col("image_size")).alias("size"))
    return m.filter(filters.in_range(F.col("size"), 4, 30))


@query(f"WITH {CATALOG_SQL} SELECT name, size, row_number() OVER (ORDER BY size ASC NULLS LAST, name) - 1 AS place FROM (SELECT name, CASE WHEN image_size % 7 <> 0 THEN NULL ELSE image_size END AS size FROM models)")
def order_nulls_last(spark, d):
    m = model_catalog(spark, d).select("name", F.when(F.col("image_size") % 7 == 0, F.col("image_size")).alias("size"))
    return R.with_row_idx(ranking.order(m, "size", tie="name"), name="place")


@query("SELECT p_partkey, p_type FROM part WHERE list_has_any([p_type, p_brand], ['PROMO', 'Brand#13'])")
def tag_overlap(spark, d):
    p = table(spark, d, "part")
    return p.filter(filters.has_any_tag(F.array("p_type", "p_brand"), ["PROMO", "Brand#13"])).select("p_partkey", "p_type")


@query(f"WITH {CATALOG_SQL} SELECT DISTINCT source FROM models")
def distinct_sources(spark, d):
    return catalog_session(spark, d).sql("SELECT DISTINCT source FROM image_models;")


@query(f"WITH {CATALOG_SQL} SELECT name AS model, image_size AS size FROM models")
def projection_alias(spark, d):
    return catalog_session(spark, d).sql("SELECT name AS model, image_size size FROM image_models;")


@query(f"WITH {CATALOG_SQL} SELECT json_model FROM models WHERE image_size <= 25 AND json_model NOT IN (SELECT json_model FROM models WHERE source = 'Brand#11')")
def other_than(spark, d):
    s = catalog_session(spark, d)
    s.sql("DECLARE pool AS SELECT * FROM image_models WHERE source = 'Brand#11';")
    return s.sql("SELECT json_model FROM image_models WHERE image_size <= 25 OTHER THAN pool;")


@query(f"WITH {CATALOG_SQL} SELECT name, length(name) AS n FROM models WHERE contains(name, 'e') AND starts_with(name, 'b')")
def name_substring(spark, d):
    m = model_catalog(spark, d)
    return m.filter(F.col("name").contains("e") & F.col("name").startswith("b")).select("name", F.length("name").cast("long").alias("n"))


@query(
    f"""WITH {CATALOG_SQL}, new AS (
  SELECT json_model, CASE WHEN image_size % 2 = 0 THEN image_size + 100 END AS image_size, CAST(NULL AS BIGINT) AS num_params, 'new' AS source, ['finetuned'] AS tag FROM models WHERE image_size <= 20
  UNION ALL SELECT 'fresh' || CAST(r_regionkey AS VARCHAR), 5, 7, 'new', ['finetuned'] FROM region)
SELECT coalesce(n.json_model, o.json_model) AS json_model, coalesce(n.image_size, o.image_size) AS image_size, coalesce(n.num_params, o.num_params) AS num_params,
  CASE WHEN n.json_model IS NOT NULL THEN n.source ELSE o.source END AS source,
  array_to_string(CASE WHEN o.json_model IS NOT NULL THEN o.tag ELSE n.tag END, ',') AS tag
FROM models o FULL JOIN new n ON o.json_model = n.json_model"""
)
def register_upsert(spark, d):
    m = model_catalog(spark, d).drop("name")
    new = m.filter("image_size <= 20").select("json_model", F.when(F.col("image_size") % 2 == 0, F.col("image_size") + 100).alias("image_size"), F.lit(None).cast("long").alias("num_params"), F.lit("new").alias("source"))
    more = table(spark, d, "region").select(F.concat(F.lit("fresh"), F.col("r_regionkey").cast("string")).alias("json_model"), F.lit(5).cast("long").alias("image_size"), F.lit(7).cast("long").alias("num_params"), F.lit("new").alias("source"))
    out = C.register_models(m, new.unionByName(more), finetuned=True)
    return out.select("json_model", "image_size", "num_params", "source", F.array_join("tag", ",").alias("tag"))


@query(f"WITH {CATALOG_SQL} SELECT json_model, source FROM models UNION ALL SELECT 'fresh' || CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def insert_or_ignore(spark, d):
    m = model_catalog(spark, d).select("json_model", "source")
    new = table(spark, d, "nation").select(F.concat(F.lit("fresh"), F.col("n_nationkey").cast("string")).alias("json_model"), F.col("n_name").alias("source"))
    return C.insert_or_ignore(m, new.unionByName(m.limit(50).withColumn("source", F.lit("ignored"))), "json_model")


@query(f"WITH {CATALOG_SQL} SELECT json_model, sha256(json_model || chr(31) || source) AS job_hash FROM models")
def hash_identity(spark, d):
    return model_catalog(spark, d).select("json_model", identity.hash_of(F.col("json_model"), F.col("source")).alias("job_hash"))


# ------------------------------------------------------------- jobs and results

JOBS_SQL = """requests AS (SELECT p_partkey, c.classifier, sha256(CAST(p_partkey AS VARCHAR) || chr(31) || c.classifier) AS job_hash FROM part, (VALUES ('Euclidean NN'), ('Cosine NN')) c(classifier)),
known AS (SELECT sha256(CAST(p_partkey AS VARCHAR) || chr(31) || 'Euclidean NN') AS job_hash, p_retailprice / 1000 AS value FROM part WHERE p_size <= 20)"""


def requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    both = jobs.fan_out(p.select("p_partkey"), spark.createDataFrame([("Euclidean NN",), ("Cosine NN",)], "classifier string"), spark.range(1).select(F.lit("r").alias("reader")))
    key = identity.hash_of(F.col("p_partkey").cast("string"), F.col("classifier"))
    known = p.filter("p_size <= 20").select(identity.hash_of(F.col("p_partkey").cast("string"), F.lit("Euclidean NN")).alias("job_hash"), (F.col("p_retailprice") / 1000).alias("value"))
    return both.withColumn("job_hash", key).drop("reader"), known


@query(f"WITH {JOBS_SQL} SELECT p_partkey, classifier, round(value, 6) AS value FROM requests LEFT JOIN known USING (job_hash)")
def known_result_lookup(spark, d):
    asked, known = requests(spark, d)
    return jobs.with_known(asked, known).select("p_partkey", "classifier", F.round("value", 6).alias("value"))


@query(f"WITH {JOBS_SQL} SELECT p_partkey, classifier, job_hash FROM requests WHERE job_hash NOT IN (SELECT job_hash FROM known)")
def remaining_work_anti(spark, d):
    asked, known = requests(spark, d)
    return jobs.remaining(asked, known).select("p_partkey", "classifier", "job_hash")


@query("SELECT user_id AS request, bool_and(event_type <> 'click') AS ready, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def deps_ready_failed(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "click", "finished").otherwise("started")
    held = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("dependency"), status.alias("status"))
    out = jobs.dependency_status(held.select("request", "dependency"), held.select("dependency", "status"))
    return out.select("request", "ready", "failed")


# -------------------------------------------------------------------- datasets


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_extract(spark, d):
    e = table(spark, d, "events").withColumn("x", F.from_json("props", "k long"))
    return R.extract(e, ["x", "k"], None, {"event_id": ["event_id"]}).select("event_id", F.col("embed").alias("k"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders")
def row_numbers(spark, d):
    return R.with_row_idx(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "row_idx")


@query("SELECT event_id, value FROM events WHERE event_id >= 200 AND event_id < 900")
def slice_rows(spark, d):
    return R.slice_rows(table(spark, d, "events"), 200, 900, "event_id").select("event_id", "value")


@query("SELECT event_id, event_id // 32 AS batch FROM events WHERE event_id // 32 < (SELECT count(*) // 32 FROM events)")
def batch_numbering(spark, d):
    return R.batch_numbers(table(spark, d, "events").select("event_id"), 32, drop_remainder=True, idx="event_id")


@query("WITH n AS (SELECT 60 * 1000 // 100 AS n) SELECT event_id, part FROM (SELECT event_id, 1 AS part FROM events WHERE event_id < 800 UNION ALL SELECT event_id, 2 FROM events, n WHERE event_id >= n AND event_id < n + 200)")
def split_train800_val200(spark, d):
    parts = R.split_parts("train", 1000, 60, 20)["train800val200"]
    e = table(spark, d, "events").select("event_id")
    held = [R.read_split({"train": e}, [p], "event_id").withColumn("part", F.lit(i + 1)) for i, p in enumerate(parts)]
    return held[0].unionByName(held[1])


@query(
    """WITH sizes AS (SELECT o_orderstatus AS reader, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) - 1 AS i FROM orders GROUP BY 1),
steps AS (SELECT reader, n, ceil(n * 10.0 / (SELECT n FROM sizes WHERE i = 0)) AS step FROM sizes)
SELECT reader, least(n, CAST(step * 1 AS BIGINT)) AS stop1, least(n, CAST(step * 1 + step * 3 AS BIGINT)) AS stop2, least(n, CAST(step * 1 + step * 3 + step * 8 AS BIGINT)) AS stop3 FROM steps"""
)
def proportional_slices(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderstatus").count().orderBy("o_orderstatus").collect()
    slices = R.proportional_slices([r["count"] for r in rows], [0, 1, 2, 5], 10)
    out = [(r.o_orderstatus, *([s[1] for s in one] + [one[-1][1]] * 3)[:3]) for r, one in zip(rows, slices)]
    return spark.createDataFrame(out, "reader string, stop1 long, stop2 long, stop3 long")


@query("SELECT event_id, row_number() OVER (ORDER BY ((event_id + 7) * 2654435761) % 4294967296, event_id) - 1 AS place FROM events")
def seeded_permutation(spark, d):
    return R.permuted(table(spark, d, "events").select("event_id"), 7, "event_id")


@query("SELECT doc_id FROM documents ORDER BY ((doc_id + 3) * 2654435761) % 4294967296, doc_id LIMIT 50")
def random_subset(spark, d):
    return R.random_subset(table(spark, d, "documents").select("doc_id"), 50, "doc_id", 3)


@query("SELECT event_id, round(1.0 / n / c, 12) AS weight FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type), (SELECT count(DISTINCT event_type) AS c FROM events)")
def class_weights(spark, d):
    return R.class_weights(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", F.round("weight", 12).alias("weight"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def class_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


ITEMS_SQL = "items AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_quantity) AS kinds, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity) AS distances FROM lineitem GROUP BY l_orderkey)"


def items(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("x"))
    return held.select("l_orderkey", F.col("x.l_linenumber").alias("kinds"), F.col("x.q").alias("distances"))


def _bucket_sql(value: str, bounds: tuple[float, ...]) -> str:
    return " + ".join(f"CASE WHEN {value} > {b} THEN 1 ELSE 0 END" for b in bounds) + " - 1"


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, CASE WHEN list_min(distances) > 0 THEN {_bucket_sql('list_min(distances)', L.CLOSEST_OBJECT_BOUNDS)} END AS label FROM items")
def label_bucket_distance(spark, d):
    return items(spark, d).select("l_orderkey", L.closest_object(F.col("distances")).alias("label"))


@query(f"WITH {ITEMS_SQL}, near AS (SELECT l_orderkey, list_min(list_append([distances[i] FOR i IN range(1, len(kinds) + 1) IF kinds[i] < 3], 1000.0)) AS m FROM items) SELECT l_orderkey, {_bucket_sql('m', L.VEHICLE_BOUNDS)} AS label FROM near")
def label_closest_vehicle(spark, d):
    return items(spark, d).select("l_orderkey", L.closest_vehicle(F.col("kinds"), F.col("distances")).alias("label"))


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, len(kinds) - 3 AS count_label, len([x FOR x IN kinds IF x = 2]) AS kind_label FROM items")
def label_counts(spark, d):
    return items(spark, d).select("l_orderkey", L.object_count(F.col("kinds")).cast("long").alias("count_label"), L.count_of_kind(F.col("kinds"), 2).cast("long").alias("kind_label"))


@query("SELECT p_partkey, CAST(floor(p_size / 2.0) AS INTEGER) AS location, CAST(floor(p_size / 2.5) AS INTEGER) AS orientation FROM part")
def label_grid_position(spark, d):
    return table(spark, d, "part").select("p_partkey", L.grid_position(F.col("p_size"), 32).alias("location"), L.grid_position(F.col("p_size"), 40).alias("orientation"))


EMB_SQL = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("embed"), F.col("label").cast("long").alias("label"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(test, train)"""
    e = embeddings(spark, d)
    return e.filter("row_idx % 5 = 0"), e.filter("row_idx % 5 <> 0")


@query(f"WITH {EMB_SQL} SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 9)) AS unit FROM emb")
def l2_normalize(spark, d):
    return embeddings(spark, d).select(F.col("row_idx").alias("vec_id"), F.transform(V.l2_normalize(V.doubles(F.col("embed"))), lambda x: F.round(x, 9)).alias("unit"))


@query(
    f"""WITH {EMB_SQL}, g AS (SELECT vec_id // 4 AS g, vec_id, v, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM emb),
long AS (SELECT g, m, i, v[i] AS x FROM (SELECT g, m, v, unnest(range(1, 65)) AS i FROM g))
SELECT g, i - 1 AS place, round(coalesce(sum(x) FILTER (WHERE m = 1), 0) / greatest(count(*) FILTER (WHERE m = 1), 1), 9) AS mean FROM long GROUP BY g, i"""
)
def masked_mean_pool(spark, d):
    e = embeddings(spark, d).select(F.floor(F.col("row_idx") / 4).cast("long").alias("g"), "row_idx", V.doubles(F.col("embed")).alias("v"), F.when(F.col("row_idx") % 3 == 0, 0).otherwise(1).alias("m"))
    held = e.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("row_idx", "v", "m"))).alias("x"))
    return held.select("g", F.posexplode(V.masked_mean(F.col("x.v"), F.col("x.m"), 64)).alias("place", "mean")).select("g", F.col("place").cast("long").alias("place"), F.round("mean", 9).alias("mean"))


# ------------------------------------------------------------------- proxies


def _view_sql(model: str) -> str:
    base = model.removesuffix("_l2")
    n = int("".join(c for c in base if c.isdigit()))
    view = f"v[1:{n}]" if base.startswith("prefix") else f"v[-{n}:]" if base.startswith("suffix") else f"[v[i] FOR i IN range(1, len(v) + 1) IF (i - 1) % {n} = 0]"
    return f"list_transform({view}, lambda x: x / sqrt(list_sum(list_transform({view}, lambda y: y * y))))" if model.endswith("_l2") else view


def _nearest_sql(models: list[str], cosine: bool = False, train: str = "vec_id % 5 <> 0", test: str = "vec_id % 5 = 0") -> str:
    views = " UNION ALL ".join(f"SELECT '{m}' AS model, vec_id, label, {_view_sql(m)} AS e FROM emb" for m in models)
    distance = "1 - list_cosine_similarity(a.e, b.e)" if cosine else "list_distance(a.e, b.e)"
    return f"""{EMB_SQL}, views AS ({views}),
pairs AS (SELECT a.model, a.vec_id AS test_idx, a.label AS test_label, b.vec_id AS train_idx, b.label AS train_label, {distance} AS d
  FROM (SELECT * FROM views WHERE {test}) a JOIN (SELECT * FROM views WHERE {train}) b ON a.model = b.model),
nearest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY model, test_idx ORDER BY d, train_idx) = 1),
errs AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE test_label <> train_label) AS raw_error FROM nearest GROUP BY model)"""


def _nearest_query(models: list[str], metric: str) -> Callable:
    def run(spark, d):
        test, train = (embedders.embed(x, models) for x in sides(spark, d))
        return neighbours.nearest(test, train, metric).select("model", "test_idx", "test_label", "train_idx", "train_label")

    return run


for _name, _metric in (("nn_euclid", neighbours.EUCLIDEAN), ("nn_cosine", neighbours.COSINE)):
    _run = _nearest_query(["prefix16", "prefix64", "stride4"], _metric)
    _run.__name__ = _name
    query(f"WITH {_nearest_sql(['prefix16', 'prefix64', 'stride4'], _name == 'nn_cosine')} SELECT model, test_idx, CAST(test_label AS BIGINT) AS test_label, train_idx, CAST(train_label AS BIGINT) AS train_label FROM nearest")(_run)


@query(f"WITH {_nearest_sql(['prefix32'])} SELECT model, test_idx, train_idx FROM nearest")
def nn_expressions(spark, d):
    test, train = (embedders.embed(x, ["prefix32"]) for x in sides(spark, d))
    return neighbours.nearest_sql(test, train).select("model", "test_idx", "train_idx")


@query(f"WITH {_nearest_sql(['prefix64'])} SELECT CAST(train_idx % 4 AS INTEGER) AS train_reader, count(*) AS n, count(*) FILTER (WHERE test_label <> train_label) AS raw_error FROM nearest GROUP BY 1")
def nn_multi_reader(spark, d):
    test, train = sides(spark, d)
    readers = R.concat_readers([train.filter(F.col("row_idx") % READER_IDS == i) for i in range(READER_IDS)])
    found = neighbours.nearest(embedders.embed(test, ["prefix64"]), embedders.embed(readers, ["prefix64"]))
    return neighbours.errors(found, "train_reader").select("train_reader", "n", "raw_error")


def ranking_session(spark: SparkSession, d: str) -> Session:
    s = Session(spark)
    s.add_models("models", spark.createDataFrame([(f'{{"name":"{m}"}}', m) for m in MODELS], "json_model string, name string"))
    test, train = sides(spark, d)
    s.add_reader("emb-train", train)
    s.add_reader("emb-test", test)
    for i in range(READER_IDS):
        s.add_reader(f"emb-test-{i}", test.filter(F.floor(F.col("row_idx") / 5) % READER_IDS == i))
    return s


@query(f"""WITH {_nearest_sql(MODELS)} SELECT '{{"name":"' || model || '"}}' AS json_model, round(raw_error / n, 6) AS err FROM errs ORDER BY err, json_model LIMIT 3""")
def rank_models_err(spark, d):
    out = ranking_session(spark, d).sql('SELECT * FROM models ORDER BY err ASC TRAINED ON "emb-train" TESTED ON TASK "emb-test" CLASSIFIED BY ["Euclidean NN"] LIMIT 3;')
    return out.select("json_model", F.round("err", 6).alias("err"))


_SHORT = [m for m in MODELS if m.startswith("prefix")]


def _errs_sql(label: str, name: str, cosine: bool) -> str:
    return f"(WITH {_nearest_sql(_SHORT, cosine)} SELECT '{label}' AS classifier, model, round(raw_error / n, 6) AS err FROM errs) {name}"


@query(f"SELECT classifier, model, err, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY err, model) AS r FROM (SELECT * FROM {_errs_sql('Euclidean NN', 'a', False)} UNION ALL SELECT * FROM {_errs_sql('Cosine NN', 'b', True)})) WHERE r <= 2")
def rank_topk_per_classifier(spark, d):
    test, train = (embedders.embed(x, _SHORT) for x in sides(spark, d))
    each = [neighbours.errors(neighbours.nearest(test, train, m), "model").select(F.lit(m).alias("classifier"), "model", F.round("err", 6).alias("err")) for m in (neighbours.EUCLIDEAN, neighbours.COSINE)]
    return ranking.top_per(each[0].unionByName(each[1]), ["classifier"], "err", 2)


def _benchmark(function: str) -> None:
    def run(spark, d):
        names = ", ".join(f'"emb-test-{i}"' for i in range(READER_IDS))
        out = ranking_session(spark, d).sql(f'SELECT * FROM models WHERE name = stride2 OR name = prefix8 ORDER BY {function}(err) TRAINED ON "emb-train" TESTED ON BENCHMARK [{names}] CLASSIFIED BY ["Euclidean NN"];')
        return out.select("json_model", F.round("err", 6).alias("err"))

    run.__name__ = f"benchmark_{function}"
    query(
        f"""WITH {_nearest_sql(['stride2', 'prefix8'])}, per AS (SELECT model, (test_idx // 5) % 4 AS r, avg(CASE WHEN test_label <> train_label THEN 1.0 ELSE 0.0 END) AS err FROM nearest GROUP BY 1, 2)
SELECT '{{"name":"' || model || '"}}' AS json_model, round({function}(err), 6) AS err FROM per GROUP BY model"""
    )(run)


for _f in ("avg", "min", "max", "sum"):
    _benchmark(_f)


@query(f"WITH {_nearest_sql(['prefix64'])}, c AS (SELECT test_label AS label, count(*) AS n, avg(CASE WHEN test_label <> train_label THEN 1.0 ELSE 0.0 END) AS err FROM nearest GROUP BY 1) SELECT round(sum(err * n) / sum(n), 6) AS err FROM c")
def weighted_class_error(spark, d):
    test, train = (embedders.embed(x, ["prefix64"]) for x in sides(spark, d))
    per = neighbours.errors(neighbours.nearest(test, train), "test_label")
    return per.agg(F.round(ranking.weighted_mean(F.col("err"), F.col("n")), 6).alias("err"))


@query(None)
def linear_probe(spark, d):
    test, train = (embedders.embed(x, ["prefix16", "prefix64_l2"]) for x in sides(spark, d))
    return linear.linear_probe(train, test, epochs=30)


# ------------------------------------------------------------------- overlays

CHANGES_SQL = """changes AS (
  SELECT 0 AS seq, vec_id AS base_idx, 'a' || CAST(vec_id AS VARCHAR) AS embed, NULL AS label FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 1, vec_id, 'b' || CAST(vec_id AS VARCHAR), 40 FROM embeddings WHERE vec_id % 4 = 0
  UNION ALL SELECT 2, vec_id, NULL, 50 FROM embeddings WHERE vec_id % 5 = 0)"""


def _overlay_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    base = e.select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("embed"), F.col("label").cast("long").alias("label"))
    parts = []
    for seq, (step, letter, label) in enumerate(((3, "a", None), (4, "b", 40), (5, None, 50))):
        embed = F.concat(F.lit(letter), F.col("vec_id").cast("string")) if letter else F.lit(None).cast("string")
        parts.append(e.filter(F.col("vec_id") % step == 0).select(F.lit(seq).alias("seq"), F.col("vec_id").alias("base_idx"), embed.alias("embed"), F.lit(label).cast("long").alias("label")))
    return base, parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {CHANGES_SQL}, last AS (SELECT base_idx, arg_max(embed, seq) FILTER (WHERE embed IS NOT NULL) AS embed, arg_max(label, seq) FILTER (WHERE label IS NOT NULL) AS label FROM changes GROUP BY 1)
SELECT vec_id AS row_idx, coalesce(l.embed, 'v' || CAST(vec_id AS VARCHAR)) AS embed, CAST(coalesce(l.label, e.label) AS BIGINT) AS label FROM embeddings e LEFT JOIN last l ON vec_id = base_idx"""
)
def overlay_apply(spark, d):
    return overlay.apply_overlay(*_overlay_tables(spark, d))


@query(f"WITH {CHANGES_SQL} SELECT base_idx - 10 AS base_idx, seq, CAST(label AS BIGINT) AS label FROM changes WHERE base_idx >= 10 AND base_idx < 60")
def overlay_in_slice(spark, d):
    return overlay.slice_edits(_overlay_tables(spark, d)[1], 10, 60).select("base_idx", "seq", "label")


@query(f"WITH {_nearest_sql(['prefix64'])} SELECT test_idx, CAST(CASE WHEN train_idx % 6 = 0 THEN 7 WHEN train_idx % 2 = 0 THEN 3 ELSE train_label END AS BIGINT) AS train_label FROM nearest")
def relabel_result(spark, d):
    test, train = (embedders.embed(x, ["prefix64"]) for x in sides(spark, d))
    found = neighbours.nearest(test, train)
    ids = train.select(F.col("row_idx").alias("idx"), F.lit(0).alias("reader_idx")).distinct()
    edits = ids.filter("idx % 2 = 0").withColumns({"label": F.lit(3).cast("long"), "seq": F.lit(0)}).unionByName(ids.filter("idx % 6 = 0").withColumns({"label": F.lit(7).cast("long"), "seq": F.lit(1)}))
    return overlay.relabel(found, edits).select("test_idx", "train_label")


# -------------------------------------------------------------------- halving

_CASES = [(50000, 235), (65550, 235), (1020, 235), (35126, 235), (8551, 65), (67349, 65)]


@query(
    f"""WITH RECURSIVE cases(n, m) AS (VALUES {", ".join(map(str, _CASES))}), l AS (SELECT n, m, CAST(ceil(log2(m)) AS BIGINT) AS r FROM cases),
k AS (SELECT n, m, r, m * r AS budget, 0 AS k, m AS s, CAST(0 AS BIGINT) AS big_r, CAST(0 AS BIGINT) AS total FROM l
  UNION ALL SELECT n, m, r, budget, k + 1, CAST(ceil(s / 2.0) AS BIGINT), big_r + budget // (s * r), total + big_r + budget // (s * r) FROM k WHERE k < r)
SELECT CAST(n AS BIGINT) AS "rows", CAST(m AS BIGINT) AS models, budget, CAST(ceil(n / CAST(total AS DOUBLE)) AS BIGINT) AS chunk FROM k WHERE k = r"""
)
def sh_bounds(spark, d):
    return spark.createDataFrame([(n, m, *halving.bounds(n, m)) for n, m in _CASES], "rows long, models long, budget long, chunk long")


@query(
    """WITH RECURSIVE k AS (SELECT 0 AS k, CAST(14 AS BIGINT) AS s, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS pulls
  UNION ALL SELECT k + 1, CAST(ceil(s / 2.0) AS BIGINT), total + 56 // (s * 4), 56 // (s * 4) FROM k WHERE k < 4)
SELECT CAST(a.k AS INTEGER) AS round, a.s AS survivors, b.pulls, b.total AS total_pulls, b.total * 10 AS samples FROM k a JOIN k b ON b.k = a.k + 1"""
)
def sh_schedule(spark, d):
    return halving.schedule_table(spark, 56, 14, 10)


def _halving_sql() -> str:
    """Rounds written out: errors on each prefix, and the survivors of each.

    Fourteen models take four rounds with 14, 7, 4 and 2 of them, and a budget
    of 14 * 4 pulls.  A round gives each model left 1, 2, 3 and 7 pulls, so 1,
    3, 6 and 13 in all; prefixes end after 1, 4, 10 and 23 chunks, and a chunk
    is a 23rd of the rows."""
    parts = [EMB_SQL, f"views AS ({' UNION ALL '.join(f'''SELECT '{m}' AS model, vec_id, label, {_view_sql(m)} AS e FROM emb''' for m in MODELS)})", "numbered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_idx FROM emb WHERE vec_id % 5 <> 0)", "size AS (SELECT count(*) AS n, CAST(ceil(count(*) / 23.0) AS BIGINT) AS chunk FROM numbered)", "s0 AS (SELECT DISTINCT model FROM views)"]
    for k, (chunks, survivors) in enumerate(((1, 7), (4, 4), (10, 2), (23, 1))):
        stop = f"(SELECT least(n, {chunks} * chunk) FROM size)"
        parts.append(
            f"""p{k} AS (SELECT a.model, a.vec_id AS t, a.label AS x, b.label AS y, list_distance(a.e, b.e) AS d, n.row_idx FROM views a JOIN s{k} USING (model) JOIN views b ON a.model = b.model JOIN numbered n ON n.vec_id = b.vec_id AND n.row_idx < {stop} WHERE a.vec_id % 5 = 0),
l{k} AS (SELECT model, {k} AS round, {stop} AS stop, count(*) FILTER (WHERE x <> y) AS raw_error FROM (SELECT * FROM p{k} QUALIFY row_number() OVER (PARTITION BY model, t ORDER BY d, row_idx) = 1) GROUP BY model),
s{k + 1} AS (SELECT model FROM l{k} ORDER BY raw_error, model LIMIT {survivors})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(4))
    return f"WITH {', '.join(parts)} SELECT model, CAST(round AS INTEGER) AS round, CAST(stop AS BIGINT) AS stop, raw_error FROM ({every}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY round DESC) = 1"


HALVING_SQL = _halving_sql()


@query(HALVING_SQL)
def sh_rank(spark, d):
    test, train = sides(spark, d)
    train = R.with_row_idx(train.withColumnRenamed("row_idx", "vec_id"), "vec_id").drop("vec_id")
    out = halving.successive_halving(embedders.embed(test, MODELS), embedders.embed(train, MODELS), MODELS)
    return out.select("model", "round", "stop", "raw_error")


COSTS_SQL = """costs AS (SELECT rank, mean / 10000 AS load_cost, mean / 10000000 AS inference_cost FROM (
  SELECT o_custkey % 40 + 1 AS rank, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY 1)),
pool AS (SELECT CAST(count(*) AS BIGINT) AS m, CAST(ceil(log2(count(*))) AS BIGINT) AS r FROM costs)"""


def costs(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The costs of each model of a pool of which every order is a run, and the size of the pool."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40 + 1).alias("rank")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*")).alias("mean"))
    held = o.select("rank", (F.col("mean") / 10000).alias("load_cost"), (F.col("mean") / 10000000).alias("inference_cost"))
    return held, held.count()


@query(f"WITH {COSTS_SQL} SELECT round(any_value(m) * (800 + 700 + 2 * avg(load_cost) + avg(inference_cost) * (5000 + 1000) + 0.1 * 1000) / 4 / 1000, 4) AS seconds FROM costs, pool WHERE rank <= m - 1")
def cost_sim_nosh(spark, d):
    held, models = costs(spark, d)
    return halving.cost_without(held, models, 5000, 1000, False, 4).select(F.round("seconds", 4).alias("seconds"))


COST_SQL = f"""WITH RECURSIVE {COSTS_SQL}, plan AS (SELECT 0 AS k, m AS s, m, r, 240 // (m * r) AS total FROM pool
  UNION ALL SELECT k + 1, CAST(ceil(s / 2.0) AS BIGINT), m, r, total + 240 // (CAST(ceil(s / 2.0) AS BIGINT) * r) FROM plan WHERE k + 1 < r),
base AS (SELECT avg(load_cost) AS l, avg(inference_cost) AS i FROM costs, pool WHERE rank <= m - 1),
r AS (SELECT *, row_number() OVER (ORDER BY load_cost DESC, rank) AS ld, row_number() OVER (ORDER BY load_cost, rank) AS lu, row_number() OVER (ORDER BY inference_cost DESC, rank) AS nd, row_number() OVER (ORDER BY inference_cost, rank) AS nu FROM costs),
per AS (SELECT k, s, m, total * 12 AS n, least(4, s) AS g, avg(load_cost) FILTER (WHERE ld <= s - 1) AS lx, avg(inference_cost) FILTER (WHERE nd <= s - 1) AS ix, avg(load_cost) FILTER (WHERE lu <= s) AS lm, avg(inference_cost) FILTER (WHERE nu <= s) AS im FROM (SELECT k, s, m, total FROM plan), r GROUP BY k, s, m, total)
SELECT round((sum(s * (700 + l + i * n + 5 * 1000 + 800) / g) + any_value(m * (i * 1000 + 700 + l) / 4)) / 1000, 4) AS seconds_mean,
  round((sum(s * (700 + lx + ix * n + 5 * 1000) / g) + any_value(m * (i * 1000 + 700 + l) / 4)) / 1000, 4) AS seconds_max,
  round((sum(s * (700 + lm + im * n + 5 * 1000) / g) + any_value(m * (i * 1000 + 700 + l) / 4)) / 1000, 4) AS seconds_min FROM per, base"""


@query(COST_SQL)
def cost_sim_sh(spark, d):
    out = halving.cost_with(*costs(spark, d), 1000, True, 240, 12, 4)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


# ------------------------------------------------------------ similarity of tasks

TASK_SQL = "tasks AS (SELECT label AS task, list_transform(range(1, 65), lambda i: 0.5 + list_avg(list_transform(list(v), lambda w: abs(w[i])))) AS h, list_transform(range(1, 65), lambda i: 1.0 + (label % 3) * 0.25 * (i % 2)) AS s FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) GROUP BY label)"
PAIRS_SQL = "long AS (SELECT a.task AS f, b.task AS t, i, a.h[i] AS h, b.h[i] AS g, 1 / a.h[i] AS v, 1 / b.h[i] AS w, a.s[i] / a.h[i] AS hs, b.s[i] / b.h[i] AS gs, a.h[i] / (a.h[i] + b.h[i] + 1e-8) AS p, b.h[i] / (a.h[i] + b.h[i] + 1e-8) AS q FROM tasks a, tasks b, (SELECT unnest(range(1, 65)) AS i))"
_COS = "1 - sum({0} * {1}) / (sqrt(sum({0} * {0})) * sqrt(sum({1} * {1})))"
_KL = "0.5 * ({0} / {1} - 1 + ln({1}) - ln({0}))"
DISTANCE_SQL = {
    "kl": f"sum(greatest({_KL.format('v', 'w')}, {_KL.format('w', 'v')}))",
    "asymmetric_kl": f"sum({_KL.format('v', 'w')})",
    "jsd": f"avg(0.5 * ({_KL.format('v', '((v + w) / 2)')} + {_KL.format('w', '((v + w) / 2)')}))",
    "cosine": _COS.format("p", "q"),
    "normalized_cosine": _COS.format("hs", "gs"),
    "correlation": "1 - corr(v, w)",
    "entropy": "ln(2) - avg(-p * ln(p) - (1 - p) * ln(1 - p))",
}


def task_embeddings(spark: SparkSession, d: str) -> DataFrame:
    long = embeddings(spark, d).select("label", F.posexplode(V.doubles(F.col("embed"))).alias("i", "x"))
    means = long.groupBy("label", "i").agg((F.avg(F.abs("x")) + 0.5).alias("h"))
    held = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
    scale = F.transform(F.col("x.i"), lambda i: F.lit(1.0) + (F.col("label") % 3) * 0.25 * ((i + 1) % 2))
    return held.select(F.col("label").cast("int").alias("task"), F.col("x.h").alias("hessian"), scale.alias("scale"))


def _distance(name: str, sql: str) -> None:
    def run(spark, d):
        out = similarity.pdist(task_embeddings(spark, d), name)
        return out.select("task_from", "task_to", F.round(F.col("distance") + 0.0, 6).alias("distance"))

    run.__name__ = f"task_dist_{name}"
    value = f"CASE WHEN f = t THEN 0 ELSE {sql} END" if name != "asymmetric_kl" else sql
    query(f"WITH {TASK_SQL}, {PAIRS_SQL} SELECT f AS task_from, t AS task_to, round({value} + 0.0, 6) AS distance FROM long GROUP BY f, t")(run)


for _d, _sql in DISTANCE_SQL.items():
    _distance(_d, _sql)


@query(f"WITH {TASK_SQL}, {PAIRS_SQL}, x AS (SELECT f, t, CASE WHEN f = t THEN 0 ELSE {DISTANCE_SQL['cosine']} END AS d FROM long GROUP BY f, t) SELECT f AS task_from, " + ", ".join(f'round(any_value(d) FILTER (WHERE t = {i}) + 0.0, 6) AS "to_{i}"' for i in range(10)) + " FROM x GROUP BY f")
def dist_matrix_pivot(spark, d):
    s = Session(spark)
    s.add_models("readers", spark.createDataFrame([("any",)], "name string"))
    s.embeddings["probe"] = task_embeddings(spark, d)
    out = s.sql("SELECT vec FROM readers WHERE probe = 'probe';")
    return out.select("task_from", *[F.round(F.col(str(i)) + 0.0, 6).alias(f"to_{i}") for i in range(10)])


@query(f"WITH {TASK_SQL}, {PAIRS_SQL}, x AS (SELECT f, t, {DISTANCE_SQL['normalized_cosine']} AS d FROM long WHERE f <> t GROUP BY f, t) SELECT f AS task_from, t AS task_to FROM x QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(d, 12), t) = 1")
def nearest_tasks(spark, d):
    out = similarity.pdist(task_embeddings(spark, d), "normalized_cosine").filter("task_from <> task_to").withColumn("distance", F.round("distance", 12))
    return ranking.top_per(out, ["task_from"], "distance", 1, tie="task_to").select("task_from", "task_to")


# ------------------------------------------------------------------- strategies

RECORDS_SQL = """records AS (SELECT 'm' || CAST(l_partkey % 40 AS VARCHAR) AS model, 't' || CAST(l_suppkey % 6 AS VARCHAR) AS task, CAST(sum(CAST(round((l_discount + l_tax) * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS accuracy, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100000 AS elapsed_time FROM lineitem GROUP BY 1, 2),
proxies AS (SELECT 'm' || CAST(l_partkey % 40 AS VARCHAR) AS model, 't' || CAST(l_suppkey % 6 AS VARCHAR) AS task, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (50.0 * count(*)) AS err FROM lineitem GROUP BY 1, 2)"""


def records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    by = [F.concat(F.lit("m"), (F.col("l_partkey") % 40).cast("string")).alias("model"), F.concat(F.lit("t"), (F.col("l_suppkey") % 6).cast("string")).alias("task")]
    return (
        # whole numbers are summed, so the order of rows can't change a digit
        li.groupBy(*by).agg((F.sum(F.round((F.col("l_discount") + F.col("l_tax")) * 100).cast("long")).cast("double") / (F.lit(100.0) * F.count("*"))).alias("accuracy"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100000).alias("elapsed_time")),
        li.groupBy(*by).agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / (F.lit(50.0) * F.count("*"))).alias("err")),
    )


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT 'enumeration' AS strategy, model FROM proxies")
def enumeration(spark, d):
    return strategies.enumeration(records(spark, d)[1].select("model").distinct())


@query("SELECT 'random' AS strategy, CAST(p_partkey AS VARCHAR) AS model FROM (SELECT p_partkey FROM part ORDER BY ((p_partkey + 5) * 2654435761) % 4294967296, p_partkey LIMIT 7)")
def random_strategy(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("model"), "p_partkey")
    return strategies.random_search(p, 7, "p_partkey", 5)


@query(f"WITH {RECORDS_SQL} SELECT 'proxy' AS strategy, model FROM proxies WHERE task = 't1' ORDER BY err, model LIMIT 5")
def proxy_strategy(spark, d):
    return strategies.proxy(records(spark, d)[1], "t1", 5)


META_SQL = "meta AS (SELECT model FROM proxies WHERE task = 't1' AND model IN (SELECT model FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, model) AS r FROM records WHERE task <> 't1') WHERE r <= 3) ORDER BY err, model LIMIT 1)"


@query(f"WITH {RECORDS_SQL}, {META_SQL} SELECT 'meta_learned' AS strategy, model FROM meta")
def meta_learned(spark, d):
    rec, prox = records(spark, d)
    return strategies.meta_learned(rec, prox, "t1", 3)


@query(f"WITH {RECORDS_SQL} SELECT task, model, accuracy, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, model) AS r FROM records) WHERE r <= 2")
def best_of_tasks(spark, d):
    return strategies.best_of_tasks(records(spark, d)[0], 2).select("task", "model", "accuracy", "rank")


@query(
    f"""WITH {RECORDS_SQL}, {META_SQL}, c AS (SELECT 'meta_learned' AS strategy, model FROM meta UNION ALL SELECT * FROM (SELECT 'proxy', model FROM proxies WHERE task = 't1' ORDER BY err, model LIMIT 5) UNION ALL SELECT DISTINCT 'enumeration', model FROM proxies)
SELECT strategy, count(*) AS models, round(sum(elapsed_time), 6) AS finetune_time, max(accuracy) AS best_accuracy FROM c JOIN records USING (model) WHERE task = 't1' GROUP BY strategy"""
)
def strategy_compare(spark, d):
    rec, prox = records(spark, d)
    out = strategies.compare([strategies.meta_learned(rec, prox, "t1", 3), strategies.proxy(prox, "t1", 5), strategies.enumeration(prox.select("model").distinct())], rec, "t1")
    return out.select("strategy", "models", F.round("finetune_time", 6).alias("finetune_time"), "best_accuracy")


@query(f"WITH {RECORDS_SQL} SELECT task, round(1 - (5 / 6.0) * (1 - sqrt(greatest(0, 1 - min(err) / (5 / 6.0)))), 6) AS bound FROM proxies GROUP BY task")
def accuracy_bound(spark, d):
    prox = records(spark, d)[1]
    classes = prox.select("task").distinct().withColumn("classes", F.lit(6.0))
    return strategies.accuracy_bound(prox, classes).select("task", F.round("bound", 6).alias("bound"))


@query(f"WITH {RECORDS_SQL} SELECT task, model, round(max(accuracy) OVER (PARTITION BY task) - accuracy, 10) AS gap FROM records")
def gap_to_best(spark, d):
    return strategies.gap_to_best(records(spark, d)[0]).select("task", "model", F.round("gap", 10).alias("gap"))


@query(f"WITH {RECORDS_SQL} SELECT model, task, err, accuracy FROM proxies LEFT JOIN (SELECT * FROM records WHERE task <> 't2') USING (model, task)")
def proxies_with_records(spark, d):
    rec, prox = records(spark, d)
    return strategies.with_records(prox, rec.filter("task <> 't2'"))


@query(f"WITH {RECORDS_SQL} SELECT round(sum(elapsed_time) * 65 / count(*), 6) AS seconds FROM records")
def extrapolated_time(spark, d):
    return strategies.extrapolated_time(records(spark, d)[0], 65).select(F.round("seconds", 6).alias("seconds"))


@query(f"WITH {RECORDS_SQL} SELECT task AS strategy, round(avg(accuracy), 10) AS accuracy_mean, min(accuracy) AS accuracy_min, max(accuracy) AS accuracy_max FROM records GROUP BY task")
def summary_by_strategy(spark, d):
    out = strategies.by_strategy(records(spark, d)[0].withColumnRenamed("task", "strategy"), "accuracy")
    return out.withColumn("accuracy_mean", F.round("accuracy_mean", 10))


@query(f"WITH {RECORDS_SQL} SELECT task, model, round(sum(accuracy * elapsed_time) OVER w / sum(elapsed_time) OVER w, 6) AS running FROM records WINDOW w AS (PARTITION BY task ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_average(spark, d):
    out = ranking.running_mean(records(spark, d)[0], ["task"], "model", "accuracy", "elapsed_time")
    return out.select("task", "model", F.round("running", 6).alias("running"))


LEEP_SQL = f"""{EMB_SQL}, e0 AS (SELECT 'whole' AS model, vec_id, label, v FROM emb UNION ALL SELECT 'stride4', vec_id, label, [v[i] FOR i IN range(1, len(v) + 1) IF (i - 1) % 4 = 0] FROM emb),
o AS (SELECT model, vec_id, label, len(v) AS k, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS p FROM e0),
l AS (SELECT model, vec_id, label, z, p[z] AS p FROM (SELECT *, unnest(range(1, k + 1)) AS z FROM o)),
j AS (SELECT model, label, z, sum(p) AS j FROM l GROUP BY ALL), m AS (SELECT model, z, sum(j) AS m FROM j GROUP BY ALL),
e AS (SELECT l.model, vec_id, sum(p * j / m) AS e FROM l JOIN j USING (model, label, z) JOIN m USING (model, z) GROUP BY ALL)"""


@query(f"WITH {LEEP_SQL} SELECT model, round(avg(ln(e)), 6) AS leep FROM e GROUP BY model")
def leep(spark, d):
    e = embeddings(spark, d)
    out = None
    whole = V.doubles(F.col("embed"))
    for name, v in (("whole", whole), ("stride4", V.stride(whole, 4))):
        one = e.select(F.lit(name).alias("model"), F.col("row_idx").alias("row"), "label", V.softmax(v).alias("probs"))
        out = one if out is None else out.unionByName(one)
    return strategies.leep(out).select("model", F.round("leep", 6).alias("leep"))


# ------------------------------------------------------- algebra of label spaces

_TASKS_SQL = """named AS (SELECT 0 AS task_id, doc_id AS image, [CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END] AS labels FROM documents
  UNION ALL SELECT 1, doc_id, [quality + 1, toxic + 1] FROM labels),
long AS (SELECT task_id, image, generate_subscripts(labels, 1) AS place, unnest(labels) AS label FROM named),
names(task_id, label, name) AS (VALUES (0, 0, 'en'), (0, 1, 'fr'), (0, 2, 'de'), (0, 3, 'es'), (1, 1, 'fr'), (1, 2, 'yes'))"""
_NAMES = [(0, 0, "en"), (0, 1, "fr"), (0, 2, "de"), (0, 3, "es"), (1, 1, "fr"), (1, 2, "yes")]


def two_tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    a = table(spark, d, "documents").select(F.lit(0).alias("task_id"), F.col("doc_id").alias("image"), F.array(lang).alias("labels"))
    b = table(spark, d, "labels").select(F.lit(1).alias("task_id"), F.col("doc_id").alias("image"), F.array(F.col("quality") + 1, F.col("toxic") + 1).alias("labels"))
    return a.unionByName(b), spark.createDataFrame(_NAMES, "task_id int, label int, name string")


def _union(mode: str, mapping: str) -> None:
    def run(spark, d):
        return tasks.union(*two_tasks(spark, d), mode).select("image", F.array_join("labels", ",").alias("labels"))

    run.__name__ = f"task_union_{mode.lower()}"
    query(
        f"""WITH {_TASKS_SQL}, u AS (SELECT DISTINCT task_id, label FROM long), map AS ({mapping}),
r AS (SELECT task_id, image, list(DISTINCT new ORDER BY new) AS ls FROM long JOIN map USING (task_id, label) GROUP BY 1, 2)
SELECT image, array_to_string(flatten(list(ls ORDER BY task_id)), ',') AS labels FROM r GROUP BY image"""
    )(run)


_union(tasks.DISJOINT, "SELECT task_id, label, dense_rank() OVER (ORDER BY task_id, label) - 1 AS new FROM u")
_union(tasks.LABELS, "SELECT task_id, label, dense_rank() OVER (ORDER BY label) - 1 AS new FROM u")
_union(tasks.LABEL_NAMES, "SELECT task_id, label, dense_rank() OVER (ORDER BY name) - 1 AS new FROM u JOIN names USING (task_id, label)")


@query(f"WITH {_TASKS_SQL}, c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS new FROM long GROUP BY label HAVING count(DISTINCT task_id) = 2) SELECT task_id, image, array_to_string(list(DISTINCT new ORDER BY new), ',') AS labels FROM long JOIN c USING (label) GROUP BY 1, 2")
def task_intersection(spark, d):
    return tasks.intersection(*two_tasks(spark, d)).select("task_id", "image", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_TASKS_SQL} SELECT a.task_id, u.label AS of_label, a.image, CASE WHEN list_contains(a.labels, u.label) THEN 1 ELSE 0 END AS label FROM named a JOIN (SELECT DISTINCT task_id, label FROM long) u USING (task_id)")
def task_binary(spark, d):
    return tasks.binary(two_tasks(spark, d)[0])


@query(f"WITH {_TASKS_SQL} SELECT image, array_to_string(list(label ORDER BY task_id, place), ',') AS labels FROM long GROUP BY image")
def task_merge_duplicates(spark, d):
    return tasks.merge_duplicates(two_tasks(spark, d)[0]).select("image", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_TASKS_SQL} SELECT task_id, image, array_to_string(list(DISTINCT label ORDER BY label), ',') AS labels FROM long WHERE label IN (SELECT label FROM long WHERE task_id = 1) AND task_id = 0 GROUP BY 1, 2")
def task_align(spark, d):
    both = two_tasks(spark, d)[0]
    return tasks.align(both.filter("task_id = 0"), both.filter("task_id = 1"))[0].select("task_id", "image", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_TASKS_SQL}, g(label, grp) AS (VALUES (0, 'germanic'), (2, 'germanic'), (1, 'romance'), (3, 'romance')), n AS (SELECT label, grp, dense_rank() OVER (PARTITION BY grp ORDER BY label) - 1 AS new FROM g) SELECT task_id, grp AS \"group\", image, array_to_string(list(DISTINCT new ORDER BY new), ',') AS labels FROM long JOIN n USING (label) GROUP BY 1, 2, 3")
def task_per_group(spark, d):
    groups = spark.createDataFrame([(0, "germanic"), (2, "germanic"), (1, "romance"), (3, "romance")], "label int, group string")
    return tasks.one_per_group(two_tasks(spark, d)[0], groups).select("task_id", "group", "image", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_TASKS_SQL}, u AS (SELECT list(DISTINCT label ORDER BY label) AS us FROM long) SELECT task_id, image, array_to_string([CASE WHEN list_contains(labels, x) THEN 1 ELSE 0 END FOR x IN us], ',') AS hot FROM named, u")
def multi_hot(spark, d):
    both = two_tasks(spark, d)[0]
    universe = tasks.universe(both).agg(F.array_sort(F.collect_set("label")).alias("us"))
    return both.crossJoin(F.broadcast(universe)).select("task_id", "image", F.array_join(V.multi_hot(F.col("labels"), F.col("us")).cast("array<string>"), ",").alias("hot"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_window(spark, d):
    from .streaming.refresh import counted_by_window

    return counted_by_window(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_models_err"](spark, sf_dir)


# registers the rest; it needs what is above
from . import catalog_queries  # noqa: E402, F401
