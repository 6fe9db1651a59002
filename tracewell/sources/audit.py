"""The audit tables that operators work on: given ones, or those made from the given test tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators import alerting, flow
from tracewell.plans.text import for_engine, run, with_tables
from tracewell.sources.mapping import ACTIONS, BASE

#: thresholds are fitted by action unless said otherwise
BY_ACTION = ["action"]


@dataclass
class Audit:
    """nodes, events, truth (node_id, uuid) and attack windows (name, start_ts, end_ts); the rest is derived when it is asked for."""

    nodes: DataFrame
    events: DataFrame
    truth: DataFrame
    windows: DataFrame
    actions: tuple[str, ...] = ACTIONS

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Audit:
        made = lambda name: run(spark, sf_dir, for_engine(with_tables(f"SELECT * FROM {name}", BASE), "spark"))
        return cls(made("prov_nodes"), made("prov_events"), made("gt_nodes"), made("attack_windows"))

    @cached_property
    def flow(self) -> DataFrame:
        return flow.information_flow(self.events, self.nodes, self.actions)

    @cached_property
    def placed(self) -> DataFrame:
        """The flow with stream_pos."""
        return flow.with_stream_pos(self.flow)

    @cached_property
    def narrow(self) -> DataFrame:
        """As ``placed``, with the columns that contexts read: what is ordered is written twice."""
        return flow.with_stream_pos(self.flow.select("host", "event_id", "ts_us", "split", "action", "src_kind", "dst_kind", "info_src", "info_dst"))

    @cached_property
    def touch(self) -> DataFrame:
        return flow.touches(self.flow)

    @cached_property
    def touch_placed(self) -> DataFrame:
        return flow.touches(self.placed)

    @cached_property
    def labelled(self) -> DataFrame:
        return flow.labelled(self.flow, self.truth)

    @cached_property
    def cased(self) -> DataFrame:
        return flow.target_cases(self.flow)

    @cached_property
    def history(self) -> DataFrame:
        return flow.histories(self.labelled, self.nodes)

    @cached_property
    def validation(self) -> DataFrame:
        return self.flow.where("split = 'validation'")

    @cached_property
    def test(self) -> DataFrame:
        return self.flow.where("split = 'test'")

    @cached_property
    def labelled_test(self) -> DataFrame:
        return self.labelled.where("split = 'test'")

    @cached_property
    def thresholds(self) -> DataFrame:
        return alerting.group_quantile_thresholds(self.validation, BY_ACTION)

    @cached_property
    def judged(self) -> DataFrame:
        """Labelled test events with their action's threshold."""
        return alerting.with_threshold(self.labelled_test, self.thresholds, BY_ACTION)

    @cached_property
    def alerts(self) -> DataFrame:
        return self.judged.where("score >= thr")

    @cached_property
    def alert_touch(self) -> DataFrame:
        return alerting.alert_touches(self.alerts)

    @cached_property
    def node_scores(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.touch.where("split = 'test'").groupBy("host", "node_id").agg(F.max("kind").alias("kind"), F.max("score").alias("node_score"), F.count("*").alias("support"))
