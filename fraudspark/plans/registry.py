"""Stored models with the tables that belong to them, and the log of promotions."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.operators.scoring import LinearModel
from fraudspark.sources import commits as C

ENTRY = (
    "commit long, version string, previous string, promoted_ms long, reason string, "
    "metrics map<string, double>"
)
DECISION = (
    "version string, champion string, at_ms long, trigger string, promote boolean, "
    "reason string"
)
TERM = "place int, feature string, weight double, mean double"

Model = LinearModel | PipelineModel


class Registry:
    """Folder ``path``: a folder per version, ``promotions`` as a commit log and one decision
    per version tried. Its parts may be shared by any number of jobs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = C.CommitLog(spark, f"{self.path}/promotions")

    def _at(self, version: str, name: str) -> str:
        return f"{self.path}/versions/{version}/{name}"

    def publish(
        self,
        version: str,
        model: Model,
        threshold: float,
        tables: dict[str, DataFrame] | None = None,
    ) -> bool:
        """Stores a version once; its description is put last, so a version is seen whole or
        not at all. False where the version was published before. Every training run names a
        version of its own."""
        if C.exists(self.spark, self._at(version, "about.json")):
            return False
        about: dict = {"version": version, "threshold": threshold}
        if isinstance(model, LinearModel):
            about |= {"kind": "linear", "intercept": model.intercept}
            terms = [
                (i, f, model.weights.get(f), model.means.get(f))
                for i, f in enumerate({**model.weights, **model.means})
            ]
            self.spark.createDataFrame(terms, TERM).coalesce(1).write.mode(
                "overwrite"
            ).parquet(self._at(version, "terms"))
        else:
            about |= {"kind": "pipeline"}
            model.write().overwrite().save(self._at(version, "pipeline"))
        for name, table in (tables or {}).items():
            table.write.mode("overwrite").parquet(self._at(version, name))
        return C.put_if_absent(
            self.spark, self._at(version, "about.json"), json.dumps(about)
        )

    def about(self, version: str) -> dict:
        return json.loads(C.read_text(self.spark, self._at(version, "about.json")))

    def load(self, version: str) -> Model:
        about = self.about(version)
        if about["kind"] == "pipeline":
            return PipelineModel.load(self._at(version, "pipeline"))
        # One row per feature of the model.
        terms = self.spark.read.schema(TERM).parquet(self._at(version, "terms")).collect()
        order = sorted(terms, key=lambda t: t.place)
        return LinearModel(
            version,
            about["intercept"],
            {t.feature: t.weight for t in order if t.weight is not None},
            {t.feature: t.mean for t in order if t.mean is not None},
            about["threshold"],
        )

    def table(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(version, name))

    def champion(self) -> dict | None:
        return self.log.last()

    def promote(
        self,
        version: str,
        promoted_ms: int,
        reason: str,
        metrics: dict[str, float],
        replaces: str | None,
    ) -> dict | None:
        """Promotes a version over the champion it was compared with. ``None`` where another
        version has become champion since: the caller compares anew."""

        def build(last: dict | None) -> dict | None:
            current = last["version"] if last else None
            if current != replaces:
                return None
            return {
                "version": version,
                "previous": current,
                "promoted_ms": promoted_ms,
                "reason": reason,
                "metrics": metrics,
            }

        return self.log.append(build)

    def decide(self, version: str, decision: dict) -> bool:
        """Keeps the decision on a version; the first one stands."""
        return C.put_if_absent(
            self.spark, f"{self.path}/decisions/{version}.json", json.dumps(decision)
        )

    def decisions(self) -> DataFrame:
        path = f"{self.path}/decisions"
        if not C.exists(self.spark, path):
            return self.spark.createDataFrame([], DECISION)
        return self.spark.read.schema(DECISION).json(path)

    def history(self, keep: int = 50) -> DataFrame:
        """The newest ``keep`` promotions; each names the version that it replaced."""
        return self.log.rows(ENTRY).orderBy(F.desc("commit")).limit(keep)
