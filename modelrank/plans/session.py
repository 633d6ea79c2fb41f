"""A session: relations, variables, and statements run as DataFrames."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedders, identity
from ..operators import filters, halving, neighbours, overlay, ranking, similarity
from ..operators.linear import EPOCHS, LEARNING_RATE, linear_probe
from ..sources.catalog import Catalog, finetuned_model, register_models, register_readers
from ..sources.scratch import kept
from . import predicates
from .lexer import StatementError
from .nodes import Classifier, Declare, Explain, Finetune, Output, Print, Purge, Reader, Readers, Register, Select, Use
from .parser import RESERVED, parse, statements

#: An extension: (models, training readers, test readers, **parameters) to rows of json_model and err.
Extension = Callable[..., DataFrame]
LINEAR = "Linear"


def random_extension(models: DataFrame, train: list[DataFrame], test: list[DataFrame], seed: int = 0) -> DataFrame:
    """Models in an order that the seed deals, each with error -1."""
    return models.select("json_model", F.lit(-1.0).alias("err"), F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "json_model"), 256).alias("__order"))


class Session:
    """Statements over a catalog and datasets.

    ``models``: name -> DataFrame with json_model and, to be evaluated, name
    (that of an embedder).  ``readers``: name -> DataFrame (row_idx, embed,
    label).  ``catalog``: where known results live; without one, answers are
    kept for the session only.

    An answer is known by what it was computed from: the rows of its datasets
    (a hash over all of them, taken once), the edits, and what the embedders
    do.  It is written once and read back, and so are the nearest neighbours
    behind it; edits of labels alone, last in a dataset's list, are put over
    stored neighbours and no distance is computed.
    """

    def __init__(self, spark: SparkSession, catalog: str | None = None, strict: bool = False):
        self.spark, self.strict = spark, strict
        self.catalog = Catalog(spark, catalog) if catalog else None
        self.tables: dict[str, DataFrame] = {}
        self.readers: dict[str, DataFrame] = {}
        self.variables: dict[str, DataFrame] = {}
        self.embeddings: dict[str, DataFrame] = {}  # probe -> (task, hessian, scale)
        self.extensions: dict[str, Extension] = {"random": random_extension}
        self.trainer: Callable[[str, list[str], float, int], dict] | None = None
        self._known: dict[str, DataFrame] = {}  # key of a question -> its stored answer
        self._nearest: dict[str, DataFrame] = {}  # key of both sides -> stored neighbours
        self._contents: dict[str, str] = {}  # dataset -> hash of its rows

    # -- relations
    def add_models(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def add_reader(self, name: str, df: DataFrame) -> None:
        """A dataset; one that had the name before is replaced."""
        self.readers[name] = df
        self._contents.pop(name, None)

    def content(self, name: str) -> str:
        """A hash of all rows of a dataset, in any order: one pass, once for each dataset."""
        if name not in self._contents:
            df = self.readers[name]
            row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
            n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row, F.lit(1)))).first()
            self._contents[name] = f"{n}:{total}:{mixed}"
        return self._contents[name]

    def add_extension(self, name: str, f: Extension) -> None:
        self.extensions[name] = f

    def use(self, place: str) -> None:
        self.catalog = Catalog(self.spark, place)

    def relation(self, name: str) -> DataFrame:
        for held in (self.variables, self.tables):
            if name in held:
                return held[name]
        if self.catalog and name in ("image_models", "text_models", "readers", "known_results"):
            return self.catalog.table(name)
        if name == "readers" and self.readers:
            return self.spark.createDataFrame([(n,) for n in sorted(self.readers)], "name string")
        raise StatementError(f"no such table: {name}")

    def known_results(self) -> DataFrame:
        if self.catalog:
            return self.catalog.table("known_results")
        return self.spark.createDataFrame([], "classifier_type string, model_json string, train_readers_json array<string>, test_readers_json array<string>, value double")

    def register_models(self, name: str, df: DataFrame, finetuned: bool = False) -> None:
        self.tables[name] = register_models(self.relation(name), df, finetuned)
        if self.catalog and name in ("image_models", "text_models"):
            self.tables.pop(name)
            self.catalog.save(name, register_models(self.catalog.table(name), df, finetuned))

    # -- what can be asked without a statement
    def models(self, name: str = "image_models", tags: list[str] | None = None) -> DataFrame:
        """A catalog, or its models that have any of some tags."""
        df = self.relation(name)
        return df.filter(filters.has_any_tag(F.col("tag"), tags)) if tags else df

    def model(self, json_model: str, name: str = "image_models") -> DataFrame:
        return self.relation(name).filter(F.col("json_model") == json_model)

    def reader(self, name: str) -> DataFrame:
        """The registered row of a dataset: its JSON, size and path."""
        return self.relation("readers").filter(F.col("name") == name)

    def rank(self, models: str, train: list[str], test: list[str], classifiers: list[str], limit: int | None = None, benchmark: bool = False) -> DataFrame:
        """The ranking that the statement of the same parts gives."""
        sides = [Readers(tuple(Reader(n) for n in x), b) for x, b in ((train, False), (test, benchmark))]
        return self.select(Select((Output("*"),), models, trained=sides[0], tested=sides[1], classifiers=tuple(map(Classifier, classifiers)), limit=limit))

    def neighbours(self, model: str, train: list[str], test: list[str], classifier: str = neighbours.EUCLIDEAN) -> DataFrame:
        """The nearest training row of every test row under one model."""
        sides = [Readers(tuple(map(Reader, x))) for x in (train, test)]
        return self.found(*sides, [model], classifier)

    def task_distance(self, probe: str, distance: str = "cosine") -> DataFrame:
        return similarity.pdist(self.embeddings[probe], distance)

    def progress(self, statement: str) -> tuple[int, int]:
        """How many answers a ranking needs, and how many of them are not known yet."""
        q = parse(statement)
        names = sorted(r["name"] for r in predicates.filtered(self.relation(q.source), q.where, self.strict).select("name").distinct().collect())
        tests = [Readers((r,)) for r in q.tested.readers] if q.tested.benchmark else [q.tested]
        known = 0
        for c in q.classifiers:
            for test in tests:
                if self._key(q, c, names, test)[0] in self._known:
                    known += len(names)
                elif self.catalog and q.chunk is None and q.budget is None:
                    known += self._known_of(c.value, names, self._key(q, c, names, test)[1]).select("model_json").distinct().count()
        return len(names) * len(q.classifiers) * len(tests), len(names) * len(q.classifiers) * len(tests) - known

    # -- statements
    def sql(self, text: str) -> Any:
        """The result of one statement: a DataFrame, or what EXPLAIN tells."""
        return self.run(parse(text))

    def script(self, text: str) -> list[Any]:
        return [self.run(s) for s in statements(text)]

    def run(self, node: Any) -> Any:
        if isinstance(node, Select):
            return self.select(node)
        if isinstance(node, Explain):
            return self.explain(node)
        if isinstance(node, Declare):
            if node.name.lower() in RESERVED:
                raise StatementError(f"{node.name} is the name of a table")
            self.variables[node.name] = self.select(node.query)
            self.variables[node.name].createOrReplaceTempView(node.name)
            return self.variables[node.name]
        if isinstance(node, Print):
            return dict(self.variables) if node.name == "*" else self.variables[node.name]
        if isinstance(node, Register):
            return self.register(node)
        if isinstance(node, Finetune):
            return self.finetune(node)
        if isinstance(node, Use):
            return self.use(node.place)
        if isinstance(node, Purge):
            return self.purge()
        raise StatementError(f"unknown statement: {node!r}")

    def explain(self, node: Explain) -> dict:
        """Runs the query; its time, its plan, and with JSON its rows."""
        began = time.time()
        df = self.run(node.query)
        rows = [r.asDict(recursive=True) for r in df.collect()]
        out = {"seconds": round(time.time() - began, 3), "benchmark": bool(node.query.tested and node.query.tested.benchmark), "rows": len(rows), "plan": df._jdf.queryExecution().simpleString()}
        return out | {"models": rows} if node.json else out

    def write_explained(self, text: str, path: str) -> dict:
        """What EXPLAIN JSON tells, written as one JSON document."""
        out = {"statement": text} | self.sql(text)
        self.spark.createDataFrame([(json.dumps(out, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return out

    def register(self, node: Register) -> DataFrame:
        given = dict(zip(node.columns, node.values))
        meta = {k: given.pop(k, None) for k in ("size", "date_added")}
        row = [(identity.canonical(given), meta["date_added"], meta["size"], node.name, given.get("path"))]
        new = self.spark.createDataFrame(row, "json_dataset string, date_added string, size long, name string, path string").withColumn("date_added", F.col("date_added").cast("date"))
        if self.catalog:
            return self.catalog.save("readers", register_readers(self.catalog.table("readers"), new))
        self.tables["readers"] = register_readers(self.tables["readers"], new) if "readers" in self.tables else new
        return self.tables["readers"]

    def finetune(self, node: Finetune, learning_rate: float = 0.01, epochs: int = 50) -> DataFrame:
        """One job for each model; a trainer that is plugged in runs them, else they are only listed."""
        rows = []
        for model in node.models:
            key = identity.content_hash(list(node.readers), model, learning_rate, epochs)
            done = self.trainer(model, list(node.readers), learning_rate, epochs) if self.trainer else None
            rows.append((key, model, list(node.readers), learning_rate, epochs, json.dumps(done) if done else None))
            if done:
                self.completed(model, list(node.readers), learning_rate, epochs)
        out = self.spark.createDataFrame(rows, "job_hash string, json_model string, json_readers array<string>, learning_rate double, epochs long, result string")
        if self.catalog:
            self.catalog.append("finetune_jobs", out.drop("result"))
        return out

    def completed(self, base: str, readers: list[str], learning_rate: float, epochs: int) -> str:
        """Put a fine-tuned model beside its base, if a catalog has that; its json_model."""
        new = identity.canonical({"base": base, "epochs": epochs, "learning_rate": learning_rate, "readers": readers})
        names = [*self.tables, *(("image_models", "text_models") if self.catalog else ())]
        for name in names:
            held = self.relation(name)
            if "json_model" in held.columns and held.filter(F.col("json_model") == base).limit(1).count():
                self.register_models(name, finetuned_model(held, base, new), True)
                return new
        return new

    def purge(self) -> None:
        self._known.clear()
        self._nearest.clear()
        self.spark.catalog.clearCache()
        if self.catalog:
            self.catalog.purge()

    # -- queries
    def select(self, q: Select) -> DataFrame:
        if any(o.name == "vec" for o in q.outputs):
            return self.task_matrix(q)
        df = predicates.filtered(self.relation(q.source), q.where, self.strict)
        if q.other_than:
            df = ranking.other_than(df, self.relation(q.other_than))
        if q.by:
            df = self.ranked(q, df)
        elif q.trained or q.tested:
            df = self.evaluated(q, df)
        elif q.order:
            df = ranking.order(df, q.order.key, q.order.descending)
        return self.outputs(q, ranking.limit(df, q.limit) if not (q.classifiers or q.by) else df)

    def outputs(self, q: Select, df: DataFrame) -> DataFrame:
        if any(o.name == "*" for o in q.outputs):
            return df
        out = df.select(*[(F.col(o.name) if o.name.split(".")[0] in df.columns else F.get_json_object("json_model", f"$.{o.name}")).alias(o.alias or o.name) for o in q.outputs])
        return out.distinct() if any(o.distinct for o in q.outputs) else out

    def ranked(self, q: Select, df: DataFrame) -> DataFrame:
        if q.by not in self.extensions:
            raise StatementError(f"no such extension: {q.by}")
        train, test = ([self.rows(r) for r in x.readers] if x else [] for x in (q.trained, q.tested))
        out = self.extensions[q.by](df, train, test, **q.params)
        descending = bool(q.order and q.order.descending)
        key = "err" if q.order is None or q.order.key not in out.columns else q.order.key
        first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
        ties = [c for c in ("__order", "json_model") if c in out.columns]
        return ranking.limit(out.orderBy(first, *ties), q.limit).drop("__order")

    def rows(self, reader: Reader) -> DataFrame:
        """A dataset with its edits applied."""
        if reader.name not in self.readers:
            raise StatementError(f"no such dataset: {reader.name}")
        base, changes = self.readers[reader.name], None
        for seq, c in enumerate(reader.changes):
            other = self.readers[c.reader]
            some = overlay.edits(seq, other, list(c.base_indices), list(c.change_indices), "embed" in other.columns, "label" in other.columns, base)
            changes = some if changes is None else changes.unionByName(some)
        return base if changes is None else overlay.apply_overlay(base, changes)

    def combined(self, readers: Readers) -> DataFrame:
        out = None
        for i, r in enumerate(readers.readers):
            df = self.rows(r).withColumn("reader_idx", F.lit(i))
            out = df if out is None else out.unionByName(df)
        return out

    def evaluated(self, q: Select, models: DataFrame) -> DataFrame:
        """One row for each model and classifier: json_model, classifier, err, acc
        (and round, start, stop under halving), best first within a classifier."""
        if not (q.trained and q.tested and q.classifiers):
            raise StatementError("training data, test data and classifiers go together")
        if len(q.tested.readers) != 1 and not q.tested.benchmark and any(r.changes for r in q.tested.readers):
            raise StatementError("edits of several test datasets need BENCHMARK")
        named = {r["name"]: r["json_model"] for r in models.select("name", "json_model").distinct().collect()}  # a row for each model
        function = q.order.function if q.order else None
        out = None
        for c in q.classifiers:
            tests = [Readers((r,)) for r in q.tested.readers] if q.tested.benchmark else [q.tested]
            for test in tests:
                one = self.answer(q, c, sorted(named), test).withColumn("test_reader", F.lit(", ".join(r.name for r in test.readers)))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if q.tested.benchmark:
            out = ranking.over_benchmark(out, ["model", "classifier"], function)
        names = self.spark.createDataFrame(sorted(named.items()), "model string, json_model string")
        out = out.join(F.broadcast(names), "model").withColumn("acc", ranking.accuracy(F.col("err")))
        key = q.order.key if q.order and q.order.key in out.columns else "err"
        descending = bool(q.order and q.order.descending)
        out = ranking.top_per(out, ["classifier"], key, q.limit or (1 << 31) - 1, descending, "json_model")
        return out.orderBy("classifier", "rank").drop("rank", "model")

    def answer(self, q: Select, c: Any, names: list[str], test: Readers) -> DataFrame:
        """(model, classifier, err ...): known answers are looked up, the rest is computed, written once and remembered."""
        halved = q.chunk is not None or q.budget is not None
        key, lists = self._key(q, c, names, test)
        if key in self._known:
            return self._known[key]
        found = {r.model_json: r.value for r in self._known_of(c.value, names, lists).collect()} if self.catalog and not halved else {}
        left = [n for n in names if n not in found]
        out = self.spark.createDataFrame(sorted(found.items()), "model string, err double")
        if left:
            new = kept(self.compute(q, c, left, test, halved), "answer")
            out = new if not found else out.unionByName(new.select("model", "err"))
            if self.catalog and not halved:
                rows = new.select(F.lit("classify").alias("job_type"), F.lit(c.value).alias("classifier_type"), F.col("model").alias("model_json"), *[F.array(*map(F.lit, x)).alias(n) for n, x in zip(("train_readers_json", "test_readers_json"), lists)], F.lit(key).alias("classifier_job_hash"), F.col("err").alias("value"))
                self.catalog.append("known_results", rows)
        out = out.withColumn("classifier", F.lit(c.value))
        self._known[key] = out
        return out

    def _text(self, r: Reader) -> str:
        """A dataset with its edits as canonical text: names, and what the rows were."""
        changes = [[x.reader, self.content(x.reader), list(x.base_indices), list(x.change_indices)] for x in r.changes]
        return identity.canonical({"name": r.name, "content": self.content(r.name), "changes": changes})

    def _key(self, q: Select, c: Any, names: list[str], test: Readers) -> tuple[str, list[list[str]]]:
        """What makes a question the same, and the canonical texts of both sides' datasets."""
        for r in (*q.trained.readers, *test.readers):
            for name in (r.name, *(x.reader for x in r.changes)):
                if name not in self.readers:
                    raise StatementError(f"no such dataset: {name}")
        lists = [[self._text(r) for r in x.readers] for x in (q.trained, test)]
        lists[1].append(identity.content_hash([embedders.described(n) for n in names]))  # what the models do is part of the question
        return identity.content_hash(c.value, *lists, names, str(q.chunk), str(q.budget)), lists

    def _known_of(self, classifier: str, names: list[str], lists: list[list[str]]) -> DataFrame:
        train, test = (F.array(*map(F.lit, x)) for x in lists)
        return self.catalog.table("known_results").filter((F.col("classifier_type") == classifier) & F.col("model_json").isin(names) & (F.col("train_readers_json") == train) & (F.col("test_readers_json") == test))

    def _closing(self, side: Readers) -> tuple[Readers, DataFrame | None]:
        """The datasets without the edits of labels alone that close their lists, and these edits."""
        stems, edits = [], None
        for i, r in enumerate(side.readers):
            first, _ = overlay.closing_label_edits(["embed" not in self.readers[x.reader].columns for x in r.changes])
            stems.append(Reader(r.name, r.changes[:first]))
            for seq, x in enumerate(r.changes[first:]):
                some = overlay.edits(seq, self.readers[x.reader], list(x.base_indices), list(x.change_indices), False, True, self.readers[r.name])
                some = some.select("seq", F.lit(i).alias("reader_idx"), F.col("base_idx").alias("idx"), "label")
                edits = some if edits is None else edits.unionByName(some)
        return Readers(tuple(stems), side.benchmark), edits

    def found(self, train: Readers, test: Readers, names: list[str], metric: str) -> DataFrame:
        """The nearest neighbours of both sides, stored ones where there are any, under their edited labels."""
        (train, train_edits), (test, test_edits) = self._closing(train), self._closing(test)
        key = identity.content_hash(metric, *[[self._text(r) for r in x.readers] for x in (train, test)], [[n, embedders.described(n)] for n in names])
        if key not in self._nearest:
            sides = [embedders.embed(self.combined(x), names) for x in (test, train)]
            self._nearest[key] = kept(neighbours.nearest(*sides, metric), "neighbours")
        out = self._nearest[key]
        for edits, side in ((train_edits, "train"), (test_edits, "test")):
            out = out if edits is None else overlay.relabel(out, edits, side)
        return out

    def compute(self, q: Select, c: Any, names: list[str], test: Readers, halved: bool) -> DataFrame:
        if not halved and c.name != LINEAR:
            return neighbours.errors(self.found(q.trained, test, names, c.name), "model")
        train, held = (embedders.embed(self.combined(x), names) for x in (q.trained, test))
        if halved:
            chunk, budget = (None if x in (None, "auto") else x for x in (q.chunk, q.budget))
            return halving.successive_halving(held, train, names, chunk, budget, c.name)
        params = dict(c.params)
        return linear_probe(train, held, float(params.get("learning_rate", LEARNING_RATE)), int(params.get("num_epochs", EPOCHS)))

    def task_matrix(self, q: Select) -> DataFrame:
        """SELECT vec FROM readers WHERE probe = x: distances of all tasks that have an embedding."""
        probes = [p for p in (q.where.parts if hasattr(q.where, "parts") else [q.where]) if getattr(p, "column", "") == "probe"]
        if not probes or probes[0].value not in self.embeddings:
            raise StatementError("a probe that the session has embeddings of is needed")
        found = similarity.pdist(self.embeddings[probes[0].value])
        return ranking.matrix(found, "task_from", "task_to", "distance")
