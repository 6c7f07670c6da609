"""Model store: Spark ML folders plus an append-only metadata table, and the training run log."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablekit.functions.columns import local_table
from tablekit.operators.models import FittedModel, NeighbourStage, SparkStage, StackingStage, VotingStage, _NoModel

MODELS = (
    "model_id string, model_type string, problem string, features array<string>, label string, classes array<string>, "
    "params string, metrics map<string,double>, stage string, saved_at timestamp, deleted boolean"
)
RUNS = "job_id string, status string, at timestamp, seconds double, model_id string, model_type string, metrics map<string,double>, error string"


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- models ---------------------------------------------------------------------------------

    def save(self, model: FittedModel, metrics: DataFrame | None = None) -> str:
        values = {r["metric"]: r["value"] for r in metrics.collect()} if metrics is not None else {}
        stage = self._write(model.stage, f"{self.root}/models/{model.model_id}")
        row = (
            model.model_id, model.model_type, model.problem, model.features, model.label, model.classes,
            json.dumps({"params": model.params, "keys": model.keys}), values, json.dumps(stage), _now(), False,
        )
        self._append("model_table", [row], MODELS)
        return model.model_id

    def _write(self, stage, path: str) -> dict:
        """Save the Spark parts of a stage; return what is needed to put it together again."""
        if isinstance(stage, SparkStage):
            if isinstance(stage.model, _NoModel):
                return {"type": "constant"}
            stage.model.write().overwrite().save(path)
            return {"type": "spark", "class": type(stage.model).__module__ + ":" + type(stage.model).__name__, "kind": stage.kind, "sigmoid": stage.sigmoid}
        if isinstance(stage, NeighbourStage):
            stage.points.write.mode("overwrite").parquet(path)
            return {"type": "neighbours", "k": stage.k, "weights": stage.weights}
        if isinstance(stage, VotingStage):
            return {"type": "voting", "voting": stage.voting, "members": [self._member(m, f"{path}-{i}") for i, m in enumerate(stage.members)]}
        if isinstance(stage, StackingStage):
            return {"type": "stacking", "base": self._write(stage.base, f"{path}-base"), "meta": self._member(stage.meta, f"{path}-meta")}
        raise TypeError(f"cannot save {type(stage).__name__}")

    def _member(self, m: FittedModel, path: str) -> dict:
        facts = {n: getattr(m, n) for n in ("model_type", "problem", "features", "label", "classes", "params", "keys")}
        return {"facts": facts, "stage": self._write(m.stage, path)}

    def _read(self, stage: dict, path: str):
        import importlib

        if stage["type"] == "constant":
            return SparkStage(_NoModel(), "one_class")
        if stage["type"] == "spark":
            module, name = stage["class"].split(":")
            if not module.startswith("pyspark.ml."):
                raise ValueError(f"refusing to load {stage['class']}")
            sigmoid = tuple(stage["sigmoid"]) if stage["sigmoid"] else None
            return SparkStage(getattr(importlib.import_module(module), name).load(path), stage["kind"], sigmoid)
        if stage["type"] == "neighbours":
            return NeighbourStage(self.spark.read.parquet(path), stage["k"], stage["weights"])
        if stage["type"] == "voting":
            members = [FittedModel(**m["facts"], stage=self._read(m["stage"], f"{path}-{i}")) for i, m in enumerate(stage["members"])]
            return VotingStage(members, stage["voting"])
        meta = FittedModel(**stage["meta"]["facts"], stage=self._read(stage["meta"]["stage"], f"{path}-meta"))
        return StackingStage(self._read(stage["base"], f"{path}-base"), meta)

    def load(self, model_id: str) -> FittedModel:
        row = self.list().filter(F.col("model_id") == model_id).first()
        if row is None:
            raise KeyError(model_id)
        made = json.loads(row["params"])
        stage = self._read(json.loads(row["stage"]), f"{self.root}/models/{model_id}")
        return FittedModel(
            row["model_type"], row["problem"], row["features"], row["label"], row["classes"], stage, made["params"],
            keys=made["keys"], model_id=model_id,
        )

    def list(self) -> DataFrame:
        newest = Window.partitionBy("model_id").orderBy(F.desc("saved_at"))
        table = self.spark.read.schema(MODELS).parquet(f"{self.root}/model_table")
        return table.withColumn("_r", F.row_number().over(newest)).filter("_r = 1 and not deleted").drop("_r", "deleted")

    def delete(self, model_id: str):
        """Take the model out of the list; its files stay."""
        row = self.list().filter(F.col("model_id") == model_id).first()
        if row is None:
            raise KeyError(model_id)
        values = row.asDict() | {"saved_at": _now(), "deleted": True}
        order = ["model_id", "model_type", "problem", "features", "label", "classes", "params", "metrics", "stage", "saved_at", "deleted"]
        self._append("model_table", [tuple(values[n] for n in order)], MODELS)

    def _append(self, name: str, rows: list[tuple], schema: str):
        local_table(self.spark, rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    # -- runs -----------------------------------------------------------------------------------

    def run(self, job_id: str, model_type: str, job):
        """Run job() -> TrainResult, logging running, then completed or failed; the model is saved."""
        start = time.time()
        self._append("runs", [(job_id, "running", _now(), 0.0, None, model_type, {}, None)], RUNS)
        try:
            result = job()
            self.save(result.model, result.metrics)
        except Exception as error:
            self._append("runs", [(job_id, "failed", _now(), time.time() - start, None, model_type, {}, str(error)[:1000])], RUNS)
            raise
        values = {r["metric"]: r["value"] for r in result.metrics.collect()}
        self._append("runs", [(job_id, "completed", _now(), time.time() - start, result.model.model_id, model_type, values, None)], RUNS)
        return result

    def runs(self) -> DataFrame:
        return latest_runs(self.spark.read.schema(RUNS).parquet(f"{self.root}/runs"))


def latest_runs(log: DataFrame, job: str = "job_id", at: str = "at") -> DataFrame:
    """The newest entry per job of an append-only log."""
    newest = Window.partitionBy(job).orderBy(F.desc(at))
    return log.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def _now():
    return datetime.now(timezone.utc)
