"""Incremental training of linear and factor models from a stream of labelled rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factor as FM
from ..operators import linear as LR
from ..plans.lineage import cut


class IncrementalLogistic:
    """One or more steps on each micro-batch of (sample, label, feature, value); features may be new.

    Pass ``step`` to ``writeStream.foreachBatch``.  Weights live in the shared
    folder between batches, so a restarted query goes on from ``weights``.
    """

    def __init__(self, config: LR.Config, weights: DataFrame | None = None):
        self.config, self.weights, self.batches = config, weights, 0

    def step(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        if not rows.isEmpty():
            x = rows.where("feature is not null").select("sample", "feature", "value")
            y = rows.groupBy("sample").agg(F.max("label").alias("label"))
            new = LR.zero_weights(x)
            if self.weights is not None:
                new = self.weights.unionByName(new.join(self.weights, "feature", "left_anti"))
            self.weights = cut(LR.train(x, y, self.config, new))
            self.batches += 1
        rows.unpersist()


class IncrementalFactors:
    """The same for factorization machines of any kind."""

    def __init__(self, kind: str, config: FM.Config, views: tuple[int, ...] = (), model: FM.Model | None = None):
        self.kind, self.config, self.views, self.model = kind, config, views, model

    def step(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        if not rows.isEmpty():
            x = rows.where("feature is not null").select("sample", "feature", "value")
            y = rows.groupBy("sample").agg(F.max("label").alias("label"))
            if self.model is not None:
                xb = FM.with_view_biases(x, self.views) if self.kind == "mvm" else x
                old = self.model.params
                fresh = FM.initial(xb, self.config.rank).join(old, "feature", "left_anti")
                self.model = replace(self.model, params=old.unionByName(fresh.select(*old.columns)))
            self.model = FM.train(x, y, self.kind, self.config, self.views, self.model)
        rows.unpersist()
