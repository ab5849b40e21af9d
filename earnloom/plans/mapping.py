"""Run a mapping document: read a source table, apply its steps, write the target table."""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.steps import apply_step
from ..sources import files

log = logging.getLogger(__name__)

ABSOLUTE_MARK = "$"
ENVIRONMENT_PREFIX = "FM_"


def load_config(spark: SparkSession, home: str | None = None, environment: str | None = None) -> dict:
    """Settings from ``config.yaml`` (or ``config-<environment>.yaml``): flat ``key: value`` lines."""
    home = home or os.getenv("FM_CONFIG_HOME", ".")
    environment = environment or os.getenv("FM_ENVIRONMENT")
    name = f"config-{environment}.yaml" if environment else "config.yaml"
    settings = {}
    for line in files.read_document(spark, os.path.join(home, name)).splitlines():
        key, mark, value = line.partition(":")
        if mark and not key.lstrip().startswith("#"):
            settings[key.strip()] = value.strip().strip("'\"")
    return settings


class MappingRun:
    """One run of a mapping document, with its tokens and side inputs.

    ``mapping`` is the document itself or the name of a JSON file below ``mapper_directory``.
    """

    def __init__(
        self,
        spark: SparkSession,
        mapping: Mapping | str,
        config: Mapping | None = None,
        run_uuid: str | None = None,
        cob: str | None = None,
        time: str | None = None,
        version: str = "v1.0.0",
        environment: Mapping | None = None,
    ):
        now = datetime.now()
        self.spark = spark
        self.config = dict(config or {})
        self.directory = self.config.get("mapper_directory", "")
        self.tokens = {
            "uuid": run_uuid or str(uuid.uuid4()),
            "cob": cob or now.strftime("%Y%m%d"),
            "time": time or now.strftime("%H-%M-%S"),
            "version": version,
        }
        self.environment = dict(os.environ if environment is None else environment)
        self.notes: list[str] = []
        self.document = self._load(mapping)

    def _load(self, mapping: Mapping | str) -> dict:
        if isinstance(mapping, str):
            name = mapping if mapping.endswith(".json") else f"{mapping}.json"
            path = os.path.join(self.directory, name) if self.directory else name
            document = json.loads(files.read_document(self.spark, path))
        else:
            document = dict(mapping)
        for key, value in self.environment.items():
            if key.startswith(ENVIRONMENT_PREFIX):
                short = key[len(ENVIRONMENT_PREFIX):]
                document.update({key: value, short: value, short.lower(): value})
        return document

    @contextmanager
    def settings(self):
        """The document's session options (``arch_config``), as they were before afterwards."""
        options = self.document.get("arch_config") or {}
        before = {key: self.spark.conf.get(key, None) for key in options}
        try:
            for key, value in options.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def note(self, text: str) -> None:
        self.notes.append(text)
        log.info(text)

    def expand(self, value):
        """Replace ``{{token}}`` by the run's tokens or the document's own keys; unknown ones by nothing."""
        if not isinstance(value, str) or "{{" not in value:
            return value
        head, *rest = value.split("{{")
        out = [head]
        for piece in rest:
            token, mark, tail = piece.partition("}}")
            if not mark:
                out.append("{{" + piece)
                continue
            found = self.tokens.get(token, self.document.get(token, ""))
            out.append(("" if found is None else str(found)) + tail)
        return "".join(out)

    def read_side(self, path: str, schema=None) -> DataFrame:
        return files.read_by_extension(self.spark, self.expand(path), schema=schema)

    def _document_path(self, path: str) -> str:
        path = self.expand(path)
        if not path.endswith(".json"):
            path += ".json"
        if path.startswith(ABSOLUTE_MARK):
            return path[len(ABSOLUTE_MARK):]
        return os.path.join(self.directory, path) if self.directory else path

    def flat_steps(self, steps: Sequence[Mapping], inside: tuple[str, ...] = ()) -> list[dict]:
        """The step list with every ``include`` replaced by the steps of its file."""
        flat: list[dict] = []
        for step in steps:
            if step.get("transform_type") != "include":
                flat.append(dict(step))
                continue
            path = self._document_path(step["transform_rule_path"])
            if path in inside:
                raise ValueError(f"mapping documents include each other: {' -> '.join([*inside, path])}")
            included = json.loads(files.read_document(self.spark, path)).get("transforms")
            if not isinstance(included, list):
                raise ValueError(f"{path} has no list of transforms")
            flat.extend(self.flat_steps(included, (*inside, path)))
        return flat

    def transform(
        self,
        df: DataFrame,
        before: Callable[[DataFrame], DataFrame] | None = None,
        each: Callable[[DataFrame, Mapping], None] | None = None,
        after: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Apply hook, steps and hook. Builds the plan only (a counter step writes its checkpoint)."""
        if before:
            df = before(df)
        for step in self.flat_steps(self.document.get("transforms", [])):
            if each:
                each(df, step)
            df = apply_step(df, step, self)
        return after(df) if after else df

    def run(self, before=None, each=None, after=None) -> DataFrame | None:
        """Read the source asset, transform it and overwrite the target asset, if one is named.

        The document's session options hold until the target is written. Without a target the frame is
        returned as a plan, which later runs under the session's own options.
        """
        source = self.expand(self.document.get("from_asset_path"))
        if not source:
            return None
        with self.settings():
            df = self.transform(files.read_parquet(self.spark, source), before, each, after)
            target = self.expand(self.document.get("to_asset_path"))
            if not target:
                return df
            files.write_parquet(df, target, self.config.get("compression"))
        return files.read_parquet(self.spark, target)


def run_mapping(
    spark: SparkSession, mapping: Mapping | str, config: Mapping | None = None, before=None, each=None, after=None, **options
) -> DataFrame | None:
    """Run a mapping and the mappings it names to follow.

    ``on_success`` runs after it, ``on_error`` when it fails (without one the error is raised), and
    ``on_finally`` once in any case. A mapping that would follow itself is an error.
    """
    seen: list[str] = []

    def one(current: Mapping | str):
        job = MappingRun(spark, current, config, **options)
        name = current if isinstance(current, str) else job.document.get("name", "mapping")
        if name in seen:
            raise ValueError(f"follow-up mappings form a loop: {' -> '.join([*seen, name])}")
        seen.append(name)
        follow = job.document.get("on_success")
        try:
            result = job.run(before, each, after)
        except Exception:
            rescue = job.document.get("on_error")
            if not rescue:
                raise
            log.exception("mapping %s failed, running %s", name, rescue)
            result, follow = one(rescue), None
        finally:
            last = job.document.get("on_finally")
            if last:
                one(last)
        return one(follow) if follow else result

    return one(mapping)
