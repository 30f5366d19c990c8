"""Pipelines of named stages over a bundle of tables, from Python or YAML."""

from __future__ import annotations

import importlib.util
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Bundle = dict[str, DataFrame]
StageFunction = Callable[..., Bundle]


class PipelineError(ValueError):
    """A stage that is unknown, given twice, or out of place; or what it needs isn't there."""


@dataclass
class Stage:
    name: str
    run: StageFunction
    defaults: dict[str, Any] = field(default_factory=dict)
    requires: tuple[str, ...] = ()
    assigns: tuple[str, ...] = ()


FACTORIES: dict[str, Stage] = {}


def stage(name: str, requires: tuple[str, ...] = (), assigns: tuple[str, ...] = (), **defaults: Any) -> Callable[[StageFunction], StageFunction]:
    """Register a function (bundle, **config) -> tables that are new or changed."""

    def register(run: StageFunction) -> StageFunction:
        FACTORIES[name] = Stage(name, run, defaults, tuple(requires), tuple(assigns))
        return run

    return register


def component(requires: tuple[str, ...] = (), assigns: tuple[str, ...] = (), depends: tuple[str, ...] = ()) -> Callable[[type], type]:
    """Register a class whose instances are stages, under its own name: made with the stage's settings, called with the bundle. ``depends``: modules that have to be there when it is added."""

    def register(kind: type) -> type:
        lacking = [m for m in depends if importlib.util.find_spec(m) is None]
        if lacking:
            raise PipelineError(f"{kind.__name__} needs {', '.join(lacking)}, which isn't installed")
        stage(kind.__name__, requires, assigns)(lambda bundle, **config: kind(**config)(bundle))
        return kind

    return register


def environment(name: str, prefix: str = "PW_") -> dict[str, str]:
    """Settings of a stage in the environment: PW_<STAGE>__<KEY>."""
    head = f"{prefix}{name.upper()}__"
    return {k[len(head) :].lower(): v for k, v in os.environ.items() if k.startswith(head)}


class Pipeline:
    """Stages in order; nothing is computed before the result of one of its tables is asked for."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Stage, dict[str, Any]]] = []
        self.timings: dict[str, float] = {}
        self.ignored: list[str] = []

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.stages]

    def has(self, name: str) -> bool:
        return name in self.names

    def get(self, name: str) -> Stage:
        for n, s, _ in self.stages:
            if n == name:
                return s
        raise PipelineError(f"no stage is called {name!r}; there are {self.names}")

    def add(self, factory: str, *, name: str | None = None, before: str | int | None = None, after: str | int | None = None, first: bool = False, last: bool = False, config: dict[str, Any] | None = None) -> Pipeline:
        """Add a registered stage at the end, or where one of before, after, first and last says."""
        if factory not in FACTORIES:
            raise PipelineError(f"no stage is registered as {factory!r}; there are {sorted(FACTORIES)}")
        name = name or factory
        if self.has(name):
            raise PipelineError(f"a stage is called {name!r} already")
        if sum(x is not None and x is not False for x in (before, after, first, last)) > 1:
            raise PipelineError("only one of before, after, first and last can be given")
        at = len(self.stages)
        if first:
            at = 0
        for where, plus in ((before, 0), (after, 1)):
            if where is not None:
                if isinstance(where, str) and not self.has(where) or isinstance(where, int) and not 0 <= where < len(self.stages):
                    raise PipelineError(f"there is no stage {where!r} to be placed by")
                at = (self.names.index(where) if isinstance(where, str) else where) + plus
        own = FACTORIES[factory]
        self.stages.insert(at, (name, own, own.defaults | (config or {}) | environment(name)))
        return self

    @staticmethod
    def load(path_or_text: str) -> Pipeline:
        """From a YAML file or text: pipeline: [{name or component: …, settings}], ignore_docs: [names]."""
        text = path_or_text
        if "\n" not in path_or_text:
            try:
                with open(path_or_text) as f:
                    text = f.read()
            except OSError as e:
                raise PipelineError(f"can't read {path_or_text}: {e}") from e
        config = yaml.safe_load(text) or {}
        out = Pipeline()
        out.ignored = list(config.get("ignore_docs") or [])
        for entry in config.get("pipeline") or []:
            settings = {k: v for k, v in entry.items() if k not in ("name", "component")}
            factory = entry.get("component") or entry.get("name")
            out.add(factory, name=entry.get("name"), config=settings.pop("config", None) or settings)
        return out

    def __call__(self, bundle: Bundle) -> Bundle:
        """The bundle after all stages, with ``provenance``: (pipe, seq). What a stage requires has to be there before it."""
        bundle = dict(bundle)
        if self.ignored and "docs" in bundle and "pdf_name" in bundle["docs"].columns:
            bundle["docs"] = bundle["docs"].where(~F.col("pdf_name").isin(*self.ignored))
        spark = next(iter(bundle.values())).sparkSession
        for name, own, config in self.stages:
            lacking = [t for t in own.requires if t not in bundle]
            if lacking:
                raise PipelineError(f"stage {name!r} needs {lacking}, which no stage before it provides")
            began = time.perf_counter()
            bundle |= own.run(bundle, **config)
            self.timings[name] = time.perf_counter() - began
        bundle["provenance"] = spark.createDataFrame([(n, k) for k, n in enumerate(self.names)], "pipe string, seq int")
        return bundle

    def write(self, bundle: Bundle, folder: str) -> DataFrame:
        """Run the stages with each one's new or changed tables written below the folder, by stage and table, and read again by the next: so the lineage is cut, and each stage's results can be looked at. Returns
        (pipe, seq, table, n_rows, seconds), also in the folder, as ``log``."""
        bundle, told = dict(bundle), []
        spark = next(iter(bundle.values())).sparkSession
        for k, (name, own, config) in enumerate(self.stages):
            lacking = [t for t in own.requires if t not in bundle]
            if lacking:
                raise PipelineError(f"stage {name!r} needs {lacking}, which no stage before it provides")
            for table, frame in own.run(bundle, **config).items():
                began, path = time.perf_counter(), f"{folder}/{k:03}-{name}/{table}.parquet"
                frame.write.mode("overwrite").parquet(path)
                bundle[table] = spark.read.parquet(path)
                told.append((name, k, table, bundle[table].count(), time.perf_counter() - began))
        log = spark.createDataFrame(told, "pipe string, seq int, table string, n_rows bigint, seconds double")
        log.write.mode("overwrite").parquet(f"{folder}/log.parquet")
        return log


def guarded(docs: DataFrame, check: Any, pipe: str, message: Any, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantine (doc_id, pipe, error)) by a condition; with ``fail_fast`` the first row that fails ends the query."""
    ok = F.coalesce(check, F.lit(False))
    if fail_fast:
        return docs.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))), docs.limit(0).select("doc_id", F.lit(pipe).alias("pipe"), F.lit("").alias("error"))
    return docs.where(ok), docs.where(~ok).select("doc_id", F.lit(pipe).alias("pipe"), message.alias("error"))


def model_stage(rows: DataFrame, predict: Callable[[Any], Any], schema: str) -> DataFrame:
    """Rows through a model: ``predict`` takes and gives a pandas frame; each batch is one call. Detectors, recognisers, translators and transcribers are plugged in here."""

    def run(frames: Any) -> Any:
        for frame in frames:
            yield predict(frame)

    return rows.mapInPandas(run, schema)


def distinct_first(rows: DataFrame, key: str, predict: Callable[[Any], Any], schema: str) -> DataFrame:
    """Rows joined with a model's answers for their distinct keys, so that repeated texts are asked once."""
    return rows.join(model_stage(rows.select(key).where(F.col(key).isNotNull()).distinct(), predict, schema), key, "left")
