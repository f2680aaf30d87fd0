"""Run specifications, identities, and what a configuration will produce."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flattened(value: dict, prefix: str = "") -> dict[str, object]:
    """Nested dictionaries as one with dotted keys."""
    out: dict[str, object] = {}
    for k, v in value.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def config_cell(value: dict) -> dict[str, str]:
    """A configuration as a flat map of strings, as result tables hold it."""
    return {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in flattened(value).items()}


def named_config(value: str | dict) -> dict:
    """A bare name, ``{name: ...}``, or ``{<name>: {...}}`` as a dictionary with a name."""
    if isinstance(value, str):
        return {"name": value}
    if "name" in value:
        return dict(value)
    if len(value) != 1:
        raise ValueError("a configuration needs a name")
    name, rest = next(iter(value.items()))
    return {"name": name, **(rest or {})}


def config_list(value: str | dict | Iterable) -> list[dict]:
    return [named_config(value)] if isinstance(value, str | dict) else [named_config(v) for v in value]


def one_evaluator(value: str | dict | Iterable) -> dict:
    found = config_list(value)
    if len(found) != 1:
        raise ValueError(f"exactly one evaluator is needed, not {len(found)}")
    return found[0]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def slug_part(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_") or "run"


def run_spec(task: str, test: bool, seed: int, dataset: dict, attrs: dict, probe: dict, compactor: dict, evaluator: dict) -> dict:
    return {"task": task, "test": test, "global_seed": seed, "dataset": dataset, "sssc_attrs": attrs, "probe": probe, "compactor": compactor, "evaluator": evaluator}


def run_id(spec: dict) -> str:
    """Readable parts and ten digits of the specification's hash."""
    parts = [slug_part(spec["dataset"]["name"]), slug_part(spec["compactor"]["name"]), slug_part(spec["probe"]["name"])]
    if spec["test"]:
        parts.append("_test_")
    return "__".join(parts).replace("___test_", "__test__") + "__" + hashlib.sha256(canonical(spec).encode()).hexdigest()[:10]


def extractor_run_id(dataset: str, extractor: str, evaluator: str) -> str:
    return "__".join(slug_part(x) for x in (dataset, extractor, evaluator))


def results_dir(root: str, test: bool) -> str:
    return f"{root}/{'runs_test' if test else 'runs'}"


def expected_runs(config: dict) -> list[dict]:
    """Specifications and ids of datasets x probes x compactors, without running any."""
    evaluator = one_evaluator(config["evaluator"])
    out = []
    for dataset, probe, compactor in itertools.product(config_list(config["datasets"]), config_list(config["probes"]), config_list(config["compactors"])):
        spec = run_spec(config.get("task", "eval"), config.get("test", False), config.get("seed", 42), dataset, config.get("attrs", {}), probe, compactor, evaluator)
        out.append({"run_id": run_id(spec), "spec": spec})
    return out


def runs_table(spark: SparkSession, specs: Sequence[dict]) -> DataFrame:
    """The runs as a dimension: id, names, and the specification as JSON."""
    rows = [(run_id(s), s["dataset"]["name"], s["compactor"]["name"], s["probe"]["name"], s["evaluator"]["name"], canonical(s)) for s in specs]
    return spark.createDataFrame(rows, "run_id string, dataset string, compactor string, probe string, evaluator string, spec string")


def pair_key(*columns: str):
    """A content key for resuming: the hash of the columns' JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
