"""Configuration: nested includes, environment values, degrees, and pipeline specifications.

Text is JSON. ``$include{file}`` is replaced by the file's tree, found beside the including file; ``${NAME|default}`` by an
environment value, nested defaults included, and a name that is unset and has no default is an error. Includes come first.
Shell commands in configuration are deliberately not run. Comment lines (``#`` first) are dropped before anything else.
"""

from __future__ import annotations

import importlib
import json
import logging
import math
import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INCLUDE = re.compile(r"^\$include\{(.+)\}$")
HERE = "CURRENT_CONFIG_FILE_PATH"


def substitute(text: str, env: Mapping[str, str]) -> str:
    """Replaces ``${...}`` by balanced braces; defaults are substituted in turn."""
    out, at = [], 0
    while (start := text.find("${", at)) >= 0:
        depth, end = 0, start + 1
        while end < len(text):
            depth += (text[end] == "{") - (text[end] == "}")
            if depth == 0:
                break
            end += 1
        if depth:
            raise ValueError(f"unbalanced braces: {text[start:]}")
        name, bar, default = text[start + 2 : end].partition("|")
        if name not in env and not bar:
            raise KeyError(f"{name} is not set and has no default")
        out += [text[at:start], env[name] if name in env else substitute(default, env)]
        at = end + 1
    return "".join([*out, text[at:]])


def load(path: str | Path, env: Mapping[str, str] | None = None, _seen: tuple[Path, ...] = ()) -> object:
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} includes itself")
    env = dict(os.environ if env is None else env) | {HERE: str(path.parent)}
    lines = [x for x in path.read_text().splitlines() if not x.lstrip().startswith("#")]

    def walk(tree):
        if isinstance(tree, dict):
            return {k: walk(v) for k, v in tree.items()}
        if isinstance(tree, list):
            return [walk(v) for v in tree]
        if isinstance(tree, str):
            if m := INCLUDE.match(tree.strip()):
                return load(path.parent / substitute(m[1], env), env, (*_seen, path))
            new = substitute(tree, env)
            if new != tree:
                try:
                    return json.loads(new)
                except ValueError:
                    return new
        return tree

    return walk(json.loads("\n".join(lines)))


def required(tree: Mapping, key: str):
    if key not in tree:
        raise KeyError(f"missing: {key}")
    return tree[key]


def degrees(tree: Mapping, key: str, default: float | None = None) -> float:
    """A value in degrees, as radians."""
    return math.radians(required(tree, key) if default is None else tree.get(key, default))


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def module(name: str):
    """Registers a builder ``(spark, inputs, **params) -> DataFrame`` under a type name."""

    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


def load_user(path: str):
    """A user's builder by ``package.module:function``; it is registered under that name."""
    if path not in REGISTRY:
        where, _, name = path.partition(":")
        REGISTRY[path] = getattr(importlib.import_module(where), name)
    return REGISTRY[path]


@module("table")
def _table(spark: SparkSession, inputs: list[DataFrame], path: str, kind: str = "parquet", schema: str | None = None, options: Mapping | None = None) -> DataFrame:
    from waymark.sources.files import read_table

    return read_table(spark, path, kind, schema, **(options or {}))


@module("kitti")
def _kitti(spark: SparkSession, inputs: list[DataFrame], folder: str, poses: str | None = None) -> DataFrame:
    from waymark.sources.files import KittiSequence

    return KittiSequence(spark, folder, poses).points()


@module("euroc")
def _euroc(spark: SparkSession, inputs: list[DataFrame], folder: str) -> DataFrame:
    from waymark.sources.files import euroc_streams

    return euroc_streams(spark, folder)


@module("tum")
def _tum(spark: SparkSession, inputs: list[DataFrame], path: str) -> DataFrame:
    from waymark.sources.files import tum_trajectory

    return tum_trajectory(spark, path)


@module("stream")
def _stream(spark: SparkSession, inputs: list[DataFrame], path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    from waymark.streaming.stateful import replay

    return replay(spark, path, schema, files_per_trigger)


@module("decode")
def _decode(spark: SparkSession, inputs: list[DataFrame], kind: str) -> DataFrame:
    from waymark.operators.messages import decoded

    return decoded(inputs[0], kind)


@module("map_filter")
def _map_filter(spark: SparkSession, inputs: list[DataFrame], column: str, value: str) -> DataFrame:
    """A user filter: the column becomes the SQL expression; rows where that is null go."""
    return inputs[0].withColumn(column, F.expr(value)).where(F.col(column).isNotNull())


@module("map_sparse")
def _map_sparse(spark: SparkSession, inputs: list[DataFrame], size: float, mode: str = "round") -> DataFrame:
    from waymark.operators.maps import voxel_means

    return voxel_means(inputs[0], size, mode)


@module("map_occupancy")
def _map_occupancy(spark: SparkSession, inputs: list[DataFrame], size: float) -> DataFrame:
    from waymark.operators.maps import occupancy

    return occupancy(inputs[0], size)


@module("parquet")
def _parquet(spark: SparkSession, inputs: list[DataFrame], path: str) -> DataFrame:
    return spark.read.parquet(path)


@module("filter")
def _filter(spark: SparkSession, inputs: list[DataFrame], where: str) -> DataFrame:
    return inputs[0].where(where)


@module("merge")
def _merge(spark: SparkSession, inputs: list[DataFrame], time: str = "t_ns", seq: str = "seq") -> DataFrame:
    from waymark.operators.temporal import merge_streams

    return merge_streams(inputs, time, seq)


@module("decimate")
def _decimate(spark: SparkSession, inputs: list[DataFrame], every: int, label: str, order: list[str]) -> DataFrame:
    from waymark.operators.temporal import decimate

    return decimate(inputs[0], every, label, order)


@module("keep_latest")
def _latest(spark: SparkSession, inputs: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    from waymark.operators.temporal import keep_latest

    return keep_latest(inputs[0], keys, order)


@module("voxel_downsample")
def _voxels(spark: SparkSession, inputs: list[DataFrame], size: float, limit: int = 0, mode: str = "trunc") -> DataFrame:
    from waymark.operators.maps import downsample

    return downsample(inputs[0], size, limit, mode)


def launch_order(modules: list[Mapping]) -> list[Mapping]:
    """By priority, then name; launch_ignore leaves a module out. Names must be unique."""
    names = [required(m, "name") for m in modules]
    if len(set(names)) != len(names):
        raise ValueError("module names must be unique")
    return sorted((m for m in modules if not m.get("launch_ignore", False)), key=lambda m: (m.get("priority", 50), m["name"]))


#: What a module gives, for those who look for modules by it.
INTERFACES = {"source": ("parquet", "table", "kitti", "euroc", "tum", "stream"), "filter": ("filter", "map_filter", "decimate", "keep_latest"), "map": ("voxel_downsample", "map_sparse", "map_occupancy")}
DEFAULT_RATE = 1.0  # executions a second (fixed value)


def find(spec: Mapping, name: str | None = None, interface: str | None = None) -> list[Mapping]:
    """Modules of a specification by name or by what they give; the name server."""
    kinds = INTERFACES.get(interface, (interface,))
    return [m for m in launch_order(required(spec, "modules")) if (name is None or m["name"] == name) and (interface is None or m["type"] in kinds)]


def trigger_of(m: Mapping) -> dict[str, str]:
    """The trigger of a module that is a stream: so many executions a second."""
    rate = float(m.get("execution_rate", DEFAULT_RATE))
    if rate <= 0:
        raise ValueError("execution_rate must be positive")
    return {"processingTime": f"{round(1000 / rate)} milliseconds"}


def parameters(m: Mapping, folder: str | Path = ".") -> Mapping:
    """``params`` in place, or in a file of their own that ``params_file`` names."""
    if "params_file" in m:
        if "params" in m:
            raise ValueError(f"{m['name']}: params or params_file, not both")
        return load(Path(folder) / m["params_file"])
    return m.get("params", {})


def verbosity(m: Mapping) -> str:
    level = m.get("verbosity_level", "INFO")
    if level not in ("DEBUG", "INFO", "WARN", "ERROR"):
        raise ValueError(f"no such verbosity: {level}")
    return level


def build(spark: SparkSession, spec: Mapping, folder: str | Path = ".") -> dict[str, DataFrame]:
    """One DataFrame for each of ``modules``, which name their ``inputs`` (a name or a list); plans are declared, not run.

    A type with a colon is a user's own builder.
    """
    todo, done = {m["name"]: m for m in launch_order(required(spec, "modules"))}, {}

    def make(name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise ValueError(f"modules feed each other: {' -> '.join((*path, name))}")
        if name not in done:
            m = required(todo, name)
            inputs = m.get("inputs", [])
            frames = [make(x, (*path, name)) for x in ([inputs] if isinstance(inputs, str) else inputs)]
            kind = required(m, "type")
            logging.getLogger(f"waymark.{name}").setLevel(verbosity(m))
            done[name] = (load_user(kind) if ":" in kind else required(REGISTRY, kind))(spark, frames, **parameters(m, folder))
        return done[name]

    for name in todo:
        make(name)
    return done
