"""Extension points: classifiers, enrichers and plugins as transforms of frames."""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API_VERSION = 1


class Classifier(Protocol):
    """Adds {source}_status, {source}_label and {source}_conf."""

    source: str

    def attempts(self, mails: DataFrame) -> DataFrame: ...


class Orchestrator(Protocol):
    def decide(self, attempts: DataFrame) -> DataFrame: ...


class Enricher(Protocol):
    """Fills one namespace: a map of strings, null where it fails."""

    id: str
    namespace: str

    def patch(self, mails: DataFrame) -> Column: ...


@dataclass(frozen=True)
class Plugin:
    id: str
    namespace: str
    api_version: int = API_VERSION
    enrichers: tuple = ()
    extension: Callable[[DataFrame], DataFrame] | None = None
    projector: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> None:
        if plugin.api_version != API_VERSION:
            raise ValueError(f"{plugin.id}: version {plugin.api_version} of the interface, {API_VERSION} is needed")
        if plugin.id in self.plugins:
            raise ValueError(f"{plugin.id}: registered twice")
        self.plugins[plugin.id] = plugin

    def discover(self, group: str = "sievewright.plugins") -> None:
        for point in importlib.metadata.entry_points(group=group):
            self.add(point.load()())

    def select(self, plugin_id: str, namespace: str) -> Plugin:
        plugin = self.plugins.get(plugin_id)
        if plugin is None or plugin.namespace != namespace:
            raise ValueError(f"no plugin {plugin_id} of namespace {namespace}")
        return plugin


def enrich(decisions: DataFrame, enrichers: Iterable[Enricher]) -> DataFrame:
    """decisions with data (namespace, key: later patches win) and enrichment_errors.

    A null patch is an error: the namespace keeps what it had and the row goes to review.
    """
    out = decisions
    if "data" not in out.columns:
        out = out.withColumn("data", F.create_map().cast("map<string,map<string,string>>"))
    if "enrichment_errors" not in out.columns:
        out = out.withColumn("enrichment_errors", F.array().cast("array<string>"))
    for e in enrichers:
        out = out.withColumn("_patch", e.patch(out))
        prior = F.coalesce(F.try_element_at("data", F.lit(e.namespace)), F.create_map().cast("map<string,string>"))
        merged = F.map_concat(F.map_filter(prior, lambda k, _: ~F.map_contains_key("_patch", k)), F.col("_patch"))
        rest = F.map_filter("data", _other(e.namespace))
        out = out.withColumns(
            {
                "data": F.when(F.col("_patch").isNull(), F.col("data")).otherwise(F.map_concat(rest, F.create_map(F.lit(e.namespace), merged))),
                "enrichment_errors": F.when(F.col("_patch").isNull(), F.concat("enrichment_errors", F.array(F.lit(e.id)))).otherwise(F.col("enrichment_errors")),
                "needs_review": F.col("needs_review") | F.col("_patch").isNull(),
            }
        ).drop("_patch")
    return out


def _other(namespace: str):
    return lambda k, v: k != F.lit(namespace)
