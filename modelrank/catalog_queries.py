"""More registered queries: statements run whole, catalogs, readers, writers and what uses them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .operators import filters, halving, overlay, ranking, similarity, strategies, tasks
from .plans.session import Session
from .queries import (
    _NAMES, _TASKS_SQL, CATALOG_SQL, HALVING_SQL, ITEMS_SQL, MODELS, RECORDS_SQL, TASK_SQL, _nearest_sql, catalog_session, embeddings, items, model_catalog, query, ranking_session, records, sides, table, task_embeddings, two_tasks,
)
from .sources import catalog as C
from .sources import named, scratch
from .sources import readers as R


def folder(spark: SparkSession, name: str) -> str:
    return f"{scratch.root(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ statements


@query(f"WITH {CATALOG_SQL} SELECT json_model, source FROM models WHERE source IN ('Brand#11', 'Brand#13') AND image_size NOT IN (7, 8, 9)")
def restrict_in(spark, d):
    return catalog_session(spark, d).sql("SELECT json_model, source FROM image_models WHERE source IN ('Brand#11', 'Brand#13') AND image_size NOT IN [7, 8, 9];")


@query(f"WITH {CATALOG_SQL} SELECT json_model, num_params FROM models WHERE num_params <= 10000000 AND source = 'Brand#11'")
def restrict_scaled_number(spark, d):
    return catalog_session(spark, d).sql("SELECT json_model, num_params FROM image_models WHERE num_params < 10M AND source == 'Brand#11';")


@query(f"WITH {CATALOG_SQL} SELECT json_model, image_size AS token_length FROM models WHERE NOT list_contains(coalesce(tag, []), 'finetuned') AND image_size BETWEEN 10 AND 30")
def restrict_text_models(spark, d):
    s = Session(spark)
    s.add_models("text_models", model_catalog(spark, d).withColumnRenamed("image_size", "token_length"))
    return s.sql("SELECT json_model, token_length FROM text_models WHERE NOT FINETUNED AND token_length > 10 AND token_length < 30;")


@query(f"WITH {CATALOG_SQL} SELECT json_model, num_params // 1000 AS dimension FROM models WHERE num_params // 1000 >= 20 AND num_params // 1000 <= 90")
def restrict_dimension(spark, d):
    s = Session(spark)
    s.add_models("image_models", model_catalog(spark, d).withColumn("dimension", F.floor(F.col("num_params") / 1000)))
    return s.sql("SELECT json_model, dimension FROM image_models WHERE dimension >= 20 AND dimension <= 90;")


@query(f"WITH {CATALOG_SQL} SELECT count(*) AS n, false AS benchmark, min(json_model) AS least FROM models WHERE image_size <= 25")
def explain_json(spark, d):
    out = catalog_session(spark, d).sql("EXPLAIN JSON SELECT json_model FROM image_models WHERE image_size <= 25;")
    return spark.createDataFrame([(out["rows"], out["benchmark"], min(r["json_model"] for r in out["models"]))], "n long, benchmark boolean, least string")


@query(f"WITH {CATALOG_SQL} SELECT json_model, image_size FROM models WHERE source = 'Brand#22'")
def print_variable(spark, d):
    s = catalog_session(spark, d)
    s.sql("DECLARE pool AS SELECT json_model, image_size FROM image_models WHERE source = 'Brand#22';")
    return s.sql("PRINT pool;")


@query("""SELECT 'new' AS name, 10 AS size, '{"split":"train","tf_name":"x"}' AS json_dataset UNION ALL SELECT n_name, CAST(NULL AS BIGINT), '{"n":"' || n_name || '"}' FROM nation""")
def register_dataset(spark, d):
    s = Session(spark)
    held = table(spark, d, "nation").select(F.concat(F.lit('{"n":"'), "n_name", F.lit('"}')).alias("json_dataset"), F.lit(None).cast("date").alias("date_added"), F.lit(None).cast("long").alias("size"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("path"))
    s.add_models("readers", held)
    return s.sql("REGISTER dataset 'new' (tf_name, split, size) VALUES ('x', 'train', 10);").select("name", "size", "json_dataset")


@query(f"""WITH {CATALOG_SQL}, base AS (SELECT min(json_model) AS b FROM models)
SELECT json_model, image_size FROM models WHERE image_size <= 25 AND list_contains(coalesce(tag, []), 'finetuned')
UNION ALL SELECT '{{"base":' || to_json(b) || ',"epochs":50,"learning_rate":0.01,"readers":["train"]}}', image_size FROM base JOIN models ON json_model = b WHERE image_size <= 25""")
def finetune_statement(spark, d):
    """A trainer that is plugged in is run, and the model it gives joins the catalog."""
    s = catalog_session(spark, d)
    s.trainer = lambda model, readers, rate, epochs: {"accuracy": 1.0}
    base = s.relation("image_models").agg(F.min("json_model")).first()[0]
    s.sql(f"FINETUNE '{base}' WITH train;")
    return s.relation("image_models").filter(F.array_contains("tag", "finetuned") & (F.col("image_size") <= 25)).select("json_model", "image_size")


@query("SELECT 'sha' AS side, count(*) AS n FROM part UNION ALL SELECT 'purged', 0")
def use_and_purge(spark, d):
    s = Session(spark)
    s.sql(f"USE '{folder(spark, 'catalog')}';")
    jobs = table(spark, d, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("job_hash"), F.lit(1).alias("status"))
    s.catalog.append("tasks", jobs)
    before = s.catalog.table("tasks").agg(F.lit("sha").alias("side"), F.count("*").alias("n"))
    rows = before.collect()
    s.sql("PURGE;")
    after = s.catalog.table("tasks").count()
    return spark.createDataFrame([*map(tuple, rows), ("purged", after)], "side string, n long")


@query(f"""WITH {CATALOG_SQL} SELECT '{{"name":"' || m || '"}}' AS json_model, -1.0 AS err FROM (VALUES {", ".join(f"('{m}')" for m in MODELS)}) v(m) ORDER BY sha256('42' || chr(31) || '{{"name":"' || m || '"}}') LIMIT 5""")
def rank_by_extension(spark, d):
    return ranking_session(spark, d).sql("RANK * FROM models ORDER BY err TRAINED ON 'emb-train' TESTED ON 'emb-test' BY 'random(seed=42)' LIMIT 5;").select("json_model", "err")


@query(HALVING_SQL.replace("SELECT model, CAST(round", """SELECT '{"name":"' || model || '"}' AS json_model, CAST(round"""))
def chunk_budget_statement(spark, d):
    """The same search as a statement, with chunk and budget that fit the data."""
    s = ranking_session(spark, d)
    train = R.with_row_idx(sides(spark, d)[1].withColumnRenamed("row_idx", "vec_id"), "vec_id").drop("vec_id")
    s.add_reader("numbered", train)
    out = s.sql('SELECT * FROM models ORDER BY err ASC TRAINED ON "numbered" TESTED ON TASK "emb-test" CLASSIFIED BY ["Euclidean NN"] CHUNK AUTO BUDGET AUTO;')
    return out.select("json_model", "round", "stop", "raw_error")


_PLAIN = 'SELECT * FROM models WHERE name = prefix64 OR name = prefix8 ORDER BY err ASC TRAINED ON {} TESTED ON "emb-test" CLASSIFIED BY ["Euclidean NN"];'
_TWO = ["prefix64", "prefix8"]
_OUT = """SELECT '{"name":"' || model || '"}' AS json_model, round(raw_error / n, 6) AS err FROM errs"""


def changing_session(spark: SparkSession, d: str, what: list[str]) -> tuple[Session, str]:
    """A session, and its training data with the first 40 rows that are multiples of 3 changed to rows of ``other``."""
    s = ranking_session(spark, d)
    train = sides(spark, d)[1]
    places = [r.row_idx for r in train.filter("row_idx % 3 = 0").select("row_idx").orderBy("row_idx").limit(40).collect()]  # the edits of a statement
    other = train.select(F.col("row_idx"), *([F.transform("embed", lambda x: -x).alias("embed")] if "embed" in what else []), ((F.col("label") + 1) % 10).alias("label"))
    s.add_reader("other", other)
    return s, f"(\"emb-train\" CHANGE [{', '.join(map(str, places))}] TO other [{', '.join(map(str, places))}])"


_EDITED = "edited AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 <> 0 ORDER BY vec_id LIMIT 40)"


def _changed_sql(features: bool) -> str:
    """The search with the edits applied to the training rows."""
    sql = _nearest_sql(_TWO)
    sql = sql.replace("pairs AS (", f"{_EDITED}, pairs AS (", 1)
    new = "CASE WHEN b.vec_id IN (SELECT vec_id FROM edited) THEN (b.label + 1) % 10 ELSE b.label END"
    sql = sql.replace("b.label AS train_label", f"{new} AS train_label")
    if features:
        sql = sql.replace("list_distance(a.e, b.e)", "list_distance(a.e, CASE WHEN b.vec_id IN (SELECT vec_id FROM edited) THEN list_transform(b.e, lambda x: -x) ELSE b.e END)")
    return f"WITH {sql} {_OUT}"


@query(_changed_sql(False))
def change_labels_statement(spark, d):
    """Edits of labels alone: the second question is answered from the first one's neighbours."""
    s, edited = changing_session(spark, d, ["label"])
    s.sql(_PLAIN.format('"emb-train"'))
    return s.sql(_PLAIN.format(edited)).select("json_model", F.round("err", 6).alias("err"))


@query(_changed_sql(True))
def change_features_statement(spark, d):
    s, edited = changing_session(spark, d, ["embed", "label"])
    return s.sql(_PLAIN.format(edited)).select("json_model", F.round("err", 6).alias("err"))


@query(f"WITH {_nearest_sql(_TWO, train='vec_id % 5 = 1')} {_OUT}")
def requery_after_replace(spark, d):
    """A dataset that is replaced under its name is searched anew."""
    s = ranking_session(spark, d)
    s.sql(_PLAIN.format('"emb-train"'))
    s.add_reader("emb-train", embeddings(spark, d).filter("row_idx % 5 = 1"))
    return s.sql(_PLAIN.format('"emb-train"')).select("json_model", F.round("err", 6).alias("err"))


@query(f"WITH {_nearest_sql(_TWO)} {_OUT}")
def requery_from_catalog(spark, d):
    """Another session finds the answer in the catalog."""
    place = folder(spark, "catalog")
    for _ in range(2):
        s = ranking_session(spark, d)
        s.use(place)
        out = s.sql(_PLAIN.format('"emb-train"'))
    return out.select("json_model", F.round("err", 6).alias("err"))


@query("SELECT 2 AS asked, 2 AS left_before, 0 AS left_after")
def progress_of_a_statement(spark, d):
    s = ranking_session(spark, d)
    text = _PLAIN.format('"emb-train"')
    before = s.progress(text)
    s.sql(text)
    return spark.createDataFrame([(before[0], before[1], s.progress(text)[1])], "asked long, left_before long, left_after long")


@query(
    f"""WITH {_nearest_sql(['stride2', 'prefix8'])}, per AS (SELECT model, (test_idx // 5) % 4 AS r, avg(CASE WHEN test_label <> train_label THEN 1.0 ELSE 0.0 END) AS err FROM nearest GROUP BY 1, 2)
SELECT '{{"name":"' || model || '"}}' AS json_model, round(avg(err), 6) AS err, round(1 - avg(err), 6) AS acc FROM per WHERE r < 2 GROUP BY model"""
)
def benchmark_without_function(spark, d):
    out = ranking_session(spark, d).sql('SELECT * FROM models WHERE name = stride2 OR name = prefix8 TRAINED ON "emb-train" TESTED ON BENCHMARK ["emb-test-0", "emb-test-1"] CLASSIFIED BY ["Euclidean NN"];')
    return out.select("json_model", F.round("err", 6).alias("err"), F.round("acc", 6).alias("acc"))


# -------------------------------------------------------------------- catalogs


@query(f"WITH {CATALOG_SQL} SELECT json_model, image_size, num_params FROM models WHERE source = 'Brand#13'")
def catalog_scan(spark, d):
    """A catalog folder, written in two parts, compacted and read by a statement."""
    held = C.Catalog(spark, folder(spark, "catalog"))
    m = model_catalog(spark, d).drop("name")
    held.save("image_models", m.filter("image_size <= 25"))
    held.append("image_models", m.filter("image_size > 25"))
    held.compact("image_models")
    s = Session(spark, held.folder)
    return s.sql("SELECT json_model, image_size, num_params FROM image_models WHERE source = 'Brand#13';")


@query("""SELECT json_model, max(token_length) AS token_length, max(source) AS source FROM (SELECT '{"t":"' || p_name || '"}' AS json_model, p_size AS token_length, p_brand AS source FROM part) GROUP BY json_model""")
def register_text_models(spark, d):
    """Several new rows of a key become one row: here the last in order of size and source."""
    new = table(spark, d, "part").select(F.concat(F.lit('{"t":"'), "p_name", F.lit('"}')).alias("json_model"), F.col("p_size").cast("long").alias("token_length"), F.col("p_brand").alias("source"))
    new = new.groupBy("json_model").agg(F.max("token_length").alias("token_length"), F.max("source").alias("source"))
    twice = new.unionByName(new)
    old = spark.createDataFrame([], "json_model string, token_length long, source string, tag array<string>")
    return C.register_models(old, twice).select("json_model", "token_length", "source")


@query("SELECT n_name AS json_dataset, 'n' AS name, CASE WHEN n_nationkey < 5 THEN 7 ELSE n_regionkey END AS size FROM nation")
def register_reader_rows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("json_dataset"), F.lit("n").alias("name"), F.col("n_regionkey").cast("long").alias("size"), F.col("n_nationkey").alias("k"))
    return C.register_readers(n.drop("k"), n.filter("k < 5").select("json_dataset", F.lit(None).cast("string").alias("name"), F.lit(7).cast("long").alias("size")))


JOBS = "SELECT DISTINCT sha256(CAST(l_partkey % 50 AS VARCHAR) || chr(31) || CAST(l_suppkey AS VARCHAR)) AS job_hash, CAST(l_suppkey AS VARCHAR) AS json_reader, CAST(l_partkey % 50 AS VARCHAR) AS json_model FROM lineitem"


def inference_jobs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    model, reader = (F.col("l_partkey") % 50).cast("string"), F.col("l_suppkey").cast("string")
    return li.select(F.sha2(F.concat_ws("\x1f", model, reader), 256).alias("job_hash"), reader.alias("json_reader"), model.alias("json_model")).distinct()


@query(f"SELECT json_model, list(json_reader ORDER BY json_reader) AS readers FROM ({JOBS}) GROUP BY json_model")
def readers_of_models(spark, d):
    return C.readers_by_model(inference_jobs(spark, d))


@query(f"SELECT json_reader FROM ({JOBS}) WHERE json_model = '7'")
def readers_of_one_model(spark, d):
    return C.readers_of_model(inference_jobs(spark, d), "7")


@query(f"SELECT DISTINCT json_model FROM ({JOBS}) WHERE json_reader = '3'")
def models_of_reader(spark, d):
    jobs = inference_jobs(spark, d)
    return C.models_of_reader(jobs.filter(F.col("json_model") % 2 == 0), jobs.filter(F.col("json_model") % 2 == 1), "3")


@query(f"SELECT job_hash, CASE WHEN CAST(json_model AS INTEGER) % 2 = 0 THEN 'image' ELSE 'text' END AS modality, json_reader, json_model FROM ({JOBS}) UNION ALL SELECT 'none', NULL, NULL, NULL")
def job_of_hash(spark, d):
    jobs = inference_jobs(spark, d)
    hashes = jobs.select("job_hash").union(spark.createDataFrame([("none",)], "job_hash string"))
    return C.job_of_hash(hashes, jobs.filter(F.col("json_model") % 2 == 1), jobs.filter(F.col("json_model") % 2 == 0))


@query("SELECT p_retailprice AS value FROM part WHERE p_partkey = 11")
def known_value(spark, d):
    p = table(spark, d, "part").select(F.lit("Euclidean NN").alias("classifier_type"), F.col("p_partkey").cast("string").alias("model_json"), F.array(F.lit("a"), F.lit("b")).alias("train_readers_json"), F.array(F.lit("c")).alias("test_readers_json"), F.col("p_retailprice").alias("value"))
    other = p.withColumn("train_readers_json", F.array(F.lit("b"), F.lit("a"))).withColumn("value", F.lit(-1.0))
    return C.known_value(p.unionByName(other), "Euclidean NN", "11", ["a", "b"], ["c"]).select("value")


# ----------------------------------------------------------- readers and writers


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def csv_round_trip(spark, d):
    path = folder(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("sep", ";").csv(path)
    return R.read_csv(spark, path, {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string"}, sep=";")


@query("SELECT n_nationkey, n_name FROM nation")
def json_round_trip(spark, d):
    path = folder(spark, "json")
    table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_json_folder(spark, path, "n_nationkey long, n_name string")


@query("SELECT count(*) AS n, true AS fits FROM events")
def row_cap_of_files(spark, d):
    """Rows written with a cap: all are there, and no file has more."""
    path = folder(spark, "capped")
    R.write_rows(table(spark, d, "events"), path, max_values=5000, values_per_row=5)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return files.agg(F.sum("rows").alias("n"), (F.max("rows") <= 1000).alias("fits"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ((event_id + 3) * 2654435761) % 4294967296, event_id) - 1 AS place FROM events) WHERE place >= 100 AND place < 350")
def sample_range(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_idx"))
    return R.sample_range(e, 100, 350, seed=3).select(F.col("row_idx").alias("event_id"))


@query("SELECT event_id, epoch FROM events, (SELECT unnest(range(0, 3)) AS epoch)")
def repeat_epochs(spark, d):
    return R.repeat(table(spark, d, "events").select("event_id"), 3)


@query("SELECT event_id, CASE WHEN event_id < CAST(floor((SELECT count(*) FROM events) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS side FROM events")
def positional_split(spark, d):
    a, b = R.positional_split(table(spark, d, "events").select("event_id"), 0.8, "event_id")
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test")))


@query(
    """WITH w AS (SELECT event_id, event_type, 5000.0 / n / c AS expected, (((event_id + 2) * 2654435761) % 4294967296) / 4294967296.0 AS draw FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type), (SELECT count(DISTINCT event_type) AS c FROM events))
SELECT event_id, CAST(unnest(range(1, CAST(floor(expected) AS BIGINT) + CASE WHEN draw < expected - floor(expected) THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM w"""
)
def balanced_sample(spark, d):
    return R.balanced_sample(table(spark, d, "events").select("event_id", "event_type"), 5000, "event_id", "event_type", seed=2).select("event_id", "copy")


@query("SELECT event_id, user_id FROM events WHERE event_id IN (3, 5, 900) UNION ALL SELECT event_id, -1 FROM events WHERE event_id NOT IN (0, 1, 2) AND event_id < 10")
def rows_by_index(spark, d):
    e = table(spark, d, "events")
    some = filters.at_indices(e, [3, 5, 900], idx="event_id").select("event_id", "user_id")
    return some.unionByName(filters.at_indices(e.filter("event_id < 10"), [0, 1, 2], keep=False, idx="event_id").select("event_id", F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id")))


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def filter_with_stated_count(spark, d):
    e = table(spark, d, "events")
    stated = e.groupBy("event_type").count().filter("event_type = 'click'").first()["count"]
    return filters.counted(e, F.col("event_type") == "click", stated).select("event_id")


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, flatten([[x, x, x] FOR x IN kinds]) AS rgb, [x * 255.0 FOR x IN distances] AS scaled FROM items")
def label_pixels(spark, d):
    return items(spark, d).select("l_orderkey", L.grey_to_rgb(F.col("kinds")).alias("rgb"), L.scale_to_bytes(F.col("distances")).alias("scaled"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS label FROM events")
def extract_labels_alone(spark, d):
    e = table(spark, d, "events").withColumn("x", F.from_json("props", "k long"))
    return R.extract(e, None, ["x", "k"], {"event_id": ["event_id"]})


@query("SELECT p_name, CAST(row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#22' THEN 0 WHEN 'Brand#11' THEN 1 ELSE 2 END, p_brand, p_partkey) - 1 AS BIGINT) AS place FROM part")
def custom_order(spark, d):
    return R.with_row_idx(ranking.in_order(table(spark, d, "part"), "p_brand", ["Brand#22", "Brand#11"], tie="p_partkey"), name="place").select("p_name", "place")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, '' AS c FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), '', r_name FROM region")
def union_of_keys(spark, d):
    return ranking.union_of_keys([table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")), table(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("c"))])


# ------------------------------------------------------------------- halving

_BUDGETS = [(50000, 112, 235), (65550, 147, 235), (8551, 51, 65), (67349, 399, 65)]


@query(f"""SELECT CAST(n AS BIGINT) AS "rows", CAST(c AS BIGINT) AS chunk, CAST(m AS BIGINT) AS models, CAST(ceil(ceil(n / CAST(c AS DOUBLE)) / log2(m)) AS BIGINT) AS budget FROM (VALUES {", ".join(map(str, _BUDGETS))}) v(n, c, m)""")
def sh_default_budget(spark, d):
    return spark.createDataFrame([(n, c, m, halving.default_budget(n, c, m)) for n, c, m in _BUDGETS], "rows long, chunk long, models long, budget long")


# ------------------------------------------------------- similarity, strategies


@query(f"WITH {TASK_SQL} SELECT a.task AS task_from, b.task AS task_to, round(list_sum([0.5 * (b.h[i] / a.h[i] - 1 + ln(a.h[i]) - ln(b.h[i])) FOR i IN range(1, len(a.h) + 1)]), 6) + 0.0 AS distance FROM tasks a, tasks b WHERE a.task < 3 AND b.task >= 3")
def task_cdist(spark, d):
    t = task_embeddings(spark, d)
    out = similarity.cdist(t.filter("task < 3"), t.filter("task >= 3"), "asymmetric_kl")
    return out.select("task_from", "task_to", (F.round("distance", 6) + 0.0).alias("distance"))


_LAYERS = "l AS (SELECT a.task AS layer, a.h AS v, b.h AS w FROM tasks a JOIN tasks b ON b.task = a.task + 1)"


def layers(spark: SparkSession, d: str) -> DataFrame:
    t = task_embeddings(spark, d)
    return t.select(F.col("task").alias("layer"), F.col("hessian").alias("v")).join(t.select((F.col("task") - 1).alias("layer"), F.col("hessian").alias("w")), "layer")


@query(f"WITH {TASK_SQL}, {_LAYERS} SELECT layer, round(list_sum([0.5 * (v[i] / w[i] - 1 + ln(w[i]) - ln(v[i])) FOR i IN range(1, len(v) + 1)]), 6) + 0.0 AS kl FROM l")
def layerwise_kl(spark, d):
    return similarity.layerwise_kl(layers(spark, d)).select("layer", (F.round("kl", 6) + 0.0).alias("kl"))


@query(f"WITH {TASK_SQL}, {_LAYERS} SELECT layer, round(1 - list_cosine_similarity(v, w), 9) + 0.0 AS cosine FROM l")
def layerwise_cosine(spark, d):
    return similarity.layerwise_cosine(layers(spark, d)).select("layer", (F.round("cosine", 9) + 0.0).alias("cosine"))


@query(f"WITH {TASK_SQL}, r AS (SELECT i, sqrt(sum(h[i] * h[i]) / count(*)) AS r FROM tasks, (SELECT unnest(range(1, 65)) AS i) GROUP BY i) SELECT task, i - 1 AS place, round(h[i] / r, 9) AS value FROM tasks, r")
def normalised_embeddings(spark, d):
    out = similarity.normalised_embeddings(task_embeddings(spark, d))
    return out.select("task", F.posexplode("hessian").alias("place", "value")).select("task", F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))


_NEAR_SQL = "near(task_from, task_to, distance) AS (VALUES ('t1', 't1', 0.0), ('t1', 't4', 0.2), ('t1', 't2', 0.1), ('t2', 't3', 0.05))"


@query(f"WITH {RECORDS_SQL}, {_NEAR_SQL} SELECT 'nearest_task' AS strategy, model FROM records WHERE task = (SELECT task_to FROM near WHERE task_from = 't1' AND task_to <> 't1' ORDER BY distance LIMIT 1) ORDER BY accuracy DESC, model LIMIT 1")
def nearest_task_strategy(spark, d):
    near = spark.createDataFrame([("t1", "t1", 0.0), ("t1", "t4", 0.2), ("t1", "t2", 0.1), ("t2", "t3", 0.05)], "task_from string, task_to string, distance double")
    return strategies.nearest_task(near, records(spark, d)[0], "t1")


@query(f"WITH {RECORDS_SQL} SELECT 'distillation' AS strategy, model FROM proxies WHERE task = 't3' ORDER BY err, model LIMIT 1")
def distilled_strategy(spark, d):
    return strategies.distilled(records(spark, d)[1].filter("task = 't3'"))


@query(f"WITH {RECORDS_SQL} SELECT model, accuracy FROM records WHERE task = 't2' AND CAST(substr(model, 2) AS INTEGER) % 2 = 0")
def records_of_task(spark, d):
    held = records(spark, d)[0].withColumn("train_split", F.when(F.substring("model", 2, 5).cast("int") % 2 == 0, "train").otherwise("part")).withColumn("test_split", F.lit("test"))
    return strategies.records_of(held, "t2").select("model", "accuracy")


# ------------------------------------------------------- algebra of label spaces


@query(
    f"""WITH {_TASKS_SQL}, c AS (SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS new FROM (SELECT DISTINCT task_id, name FROM long JOIN names USING (task_id, label)) GROUP BY name HAVING count(*) = 2)
SELECT task_id, image, array_to_string(list(DISTINCT new ORDER BY new), ',') AS labels FROM long JOIN names USING (task_id, label) JOIN c USING (name) GROUP BY 1, 2"""
)
def task_intersection_by_name(spark, d):
    return tasks.intersection(*two_tasks(spark, d), tasks.LABEL_NAMES).select("task_id", "image", F.array_join("labels", ",").alias("labels"))


_GROUPS_SQL = "g(label, grp) AS (VALUES (0, 'germanic'), (2, 'germanic'), (1, 'romance'), (3, 'romance'))"


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "germanic"), (2, "germanic"), (1, "romance"), (3, "romance")], "label int, group string")


@query(f"WITH {_TASKS_SQL}, {_GROUPS_SQL} SELECT task_id, image, array_to_string(list(DISTINCT new ORDER BY new), ',') AS labels FROM long JOIN (SELECT label, dense_rank() OVER (ORDER BY grp) - 1 AS new FROM g) USING (label) GROUP BY 1, 2")
def task_by_attribute(spark, d):
    return tasks.by_attribute(two_tasks(spark, d)[0], _groups(spark)).select("task_id", "image", F.array_join("labels", ",").alias("labels"))


@query(f'WITH {_TASKS_SQL}, {_GROUPS_SQL}, n AS (SELECT grp, count(DISTINCT image) AS images FROM long JOIN g USING (label) GROUP BY grp) SELECT grp AS "group", images, CAST(row_number() OVER (ORDER BY images DESC, grp) - 1 AS INTEGER) AS place FROM n')
def task_groups_by_size(spark, d):
    return tasks.groups_by_size(two_tasks(spark, d)[0], _groups(spark))


@query(f"WITH {_TASKS_SQL} SELECT task_id, image, array_to_string(labels, ',') AS labels FROM named WHERE len(labels) = 1 AND NOT list_contains(labels, 3)")
def task_single_label(spark, d):
    held = tasks.drop_label(tasks.single_label(two_tasks(spark, d)[0]), 3)
    return held.select("task_id", "image", F.array_join("labels", ",").alias("labels"))


_LEVELS = [("en", "germanic", "west"), ("de", "germanic", "west"), ("fr", "romance", "gallic"), ("es", "romance", "iberian")]


@query(
    f"""WITH {_TASKS_SQL}, lv(name, top, low) AS (VALUES {", ".join(map(str, _LEVELS))}), n AS (SELECT DISTINCT l.label, top, low FROM names l JOIN lv USING (name) WHERE task_id = 0),
r AS (SELECT label, 'top' AS level, dense_rank() OVER (ORDER BY top) - 1 AS new FROM n UNION ALL SELECT label, 'low', dense_rank() OVER (ORDER BY low) - 1 FROM n)
SELECT level, image, CAST(new AS INTEGER) AS label FROM long JOIN r USING (label) WHERE task_id = 0"""
)
def task_taxonomy(spark, d):
    """A task for each level of a taxonomy."""
    names = spark.createDataFrame(_NAMES, "task_id int, label int, name string").filter("task_id = 0")
    held = names.join(spark.createDataFrame(_LEVELS, "name string, top string, low string"), "name").select("label", "top", "low")
    out = tasks.by_taxonomy(two_tasks(spark, d)[0].filter("task_id = 0"), held, ["top", "low"])
    return out.select("level", "image", F.col("labels")[0].alias("label"))


@query("""WITH c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer)
SELECT 'nation' AS level, c_custkey AS image, CAST(dense_rank() OVER (ORDER BY nation) - 1 AS INTEGER) AS label FROM c UNION ALL SELECT 'segment', c_custkey, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) FROM c""")
def attribute_tasks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return named.attribute_tasks(c, ["nation", "segment"], "c_custkey").select("level", "image", F.col("labels")[0].alias("label"))


@query("SELECT n_nationkey AS row_idx, n_regionkey AS label FROM nation")
def read_whole_dataset(spark, d):
    root = folder(spark, "datasets")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("row_idx"), F.col("n_regionkey").alias("label")).write.parquet(f"{root}/usps/test")
    return named.read_whole(spark, root, "USPS", "test")


@query("SELECT vec_id AS base_idx, CAST((label + 1) % 10 AS BIGINT) AS label FROM embeddings WHERE vec_id IN (3, 6, 9)")
def edits_of_labels_alone(spark, d):
    base = embeddings(spark, d)
    other = base.select("row_idx", ((F.col("label") + 1) % 10).alias("label"))
    return overlay.edits(0, other, [3, 6, 9], [3, 6, 9], False, True, base).select("base_idx", "label")
