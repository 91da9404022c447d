"""Declarative pipelines: a configuration names a source and steps; steps are functions from DataFrame to DataFrame, folded lazily into one plan that Catalyst optimises as a whole."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import columns as P
from millrace.operators import filters as Fi
from millrace.operators import sampling as S
from millrace.operators import windows as Wn
from millrace.plans.config import load, steps
from millrace.session import cut
from millrace.sources import sinks
from millrace.sources.files import scan

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def register(name: str, step: Step) -> Step:
    """Make a step known by name; names are unique."""
    if name in STEPS:
        raise ValueError(f"step {name!r} is already registered")
    STEPS[name] = step
    return step


for _name, _step in {
    "remove_columns": P.remove_columns, "select_columns": P.select_columns, "nested_extraction": P.extract_nested, "column_casting": P.cast_columns, "column_renaming": P.rename_columns,
    "row_index": P.assign_row_index, "value_override": P.override_values, "composite_id": P.composite_id, "constants": P.add_constants, "caption_selecting": P.select_caption, "matching": Fi.prune_matching, "range": Fi.prune_range,
    "duration": Fi.prune_duration, "licenses": Fi.prune_licenses, "mismatch": Fi.prune_mismatch, "generation": Fi.prune_generation_excluded, "aspect_ratio": Fi.prune_aspect_ratio, "audio_quality": Fi.prune_audio_quality,
    "sample": Fi.sample_fraction, "group_count": Wn.filter_by_group_count, "first_occurrence": Wn.first_occurrence, "fractions": Wn.split_fractions, "held_out": S.held_out_split,
}.items():
    register(_name, _step)


def build(step: Mapping[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """A step of a configuration as a function; an unknown type or argument is an error before anything runs."""
    kind = step.get("type", step["name"])
    if kind not in STEPS:
        raise ValueError(f"step {step['name']!r} has unknown type {kind!r}")
    f, arguments = STEPS[kind], {k: v for k, v in step.items() if k not in ("type", "name")}
    try:
        inspect.signature(f).bind(None, **arguments)
    except TypeError as e:
        raise ValueError(f"step {step['name']!r}: {e}") from None
    return lambda df: f(df, **arguments)


class Pipeline:
    """A resolved configuration: `source` (format, files, split), `pipeline` (steps by name), `output` (path, fractions, order_by, target_mb, add), `ancestry`."""

    def __init__(self, *layers, sets=()):
        self.config = load(layers, sets)
        unknown = set(self.config) - {"source", "pipeline", "output", "ancestry"}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        self.steps = [(s["name"], build(s)) for s in steps(self.config.get("pipeline", {}))]
        self.observed: dict[str, Observation] = {}

    def source(self, spark: SparkSession) -> DataFrame:
        s = self.config["source"]
        return scan(spark, s.get("format", "parquet"), s["files"], s.get("split"), s.get("schema"), s.get("options"))

    def apply(self, df: DataFrame, observe: bool = False) -> DataFrame:
        """The steps in order. With `observe` the rows each step lets through are counted on the way, without jobs of their own."""
        for name, step in self.steps:
            df = step(df)
            if observe:
                self.observed[name] = Observation(name)
                df = df.observe(self.observed[name], F.count(F.lit(1)).alias("n_out"))
        return df

    def run(self, spark: SparkSession, clean: bool = False, provenance_only: bool = False) -> None:
        """Read, apply, split, write, and record the run beside the data, in a file that readers of the data skip. Fractions split an input of one split in row order of `order_by`."""
        out = self.config["output"]
        if not provenance_only:
            # computed once: the split, the sampling of the ranges and the write each read the result
            df = cut(self.apply(self.source(spark), observe=True))
            if out.get("fractions"):
                df = Wn.split_fractions(df.drop("split"), out["fractions"], out["order_by"])
            sinks.write_splits(df, out["path"], target_mb=out.get("target_mb", 500), order_by=out.get("order_by", ()), clean=clean, add=out.get("add", False))
        ancestry = self.config.get("ancestry", {})
        record = sinks.provenance_record(self.config, ancestry.get("datasets", ()), ancestry.get("models", ()))
        if not provenance_only:
            record["rows_by_step"] = {name: o.get["n_out"] for name, o in self.observed.items()}
        sinks.write_json(spark, record, f"{out['path'].rstrip('/')}/_provenance.json")
