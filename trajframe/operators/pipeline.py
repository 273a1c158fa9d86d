"""Named steps from DataFrame to DataFrame, in a list that can be stored as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str) -> Callable:
    """Registers a function (frames, **options) under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in STEPS:
            raise ValueError(f"step {name!r} exists")
        STEPS[name] = f
        return f

    return add


class Pipeline:
    def __init__(self, steps: list[tuple[str, dict]]):
        for name, _ in steps:
            if name not in STEPS:
                raise ValueError(f"unknown step {name!r}")
        self.steps = list(steps)

    def stages(self, frames: DataFrame) -> Iterator[tuple[str, DataFrame]]:
        """The lazy result of every step."""
        for name, options in self.steps:
            frames = STEPS[name](frames, **options)
            yield name, frames

    def __call__(self, frames: DataFrame) -> DataFrame:
        for _, frames in self.stages(frames):  # noqa: B020
            pass
        return frames

    def __getitem__(self, part: slice) -> Pipeline:
        return Pipeline(self.steps[part])

    def with_options(self, **changes: dict) -> Pipeline:
        """A copy with some options of named steps changed; a name without a step is an error."""
        unused = set(changes) - {n for n, _ in self.steps}
        if unused:
            raise ValueError(f"no steps {sorted(unused)}")
        return Pipeline([(n, {**o, **changes.get(n, {})}) for n, o in self.steps])

    def to_json(self) -> str:
        return json.dumps([{"step": n, "options": o} for n, o in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        return cls([(s["step"], s["options"]) for s in json.loads(text)])


@step("filter")
def _filter(frames: DataFrame, condition: str) -> DataFrame:
    return frames.where(condition)


@step("select")
def _select(frames: DataFrame, cols: list[str]) -> DataFrame:
    return frames.select(*(F.col(f"`{c}`") for c in cols))


@step("rename")
def _rename(frames: DataFrame, names: dict[str, str]) -> DataFrame:
    return frames.withColumnsRenamed(names)


@step("scale")
def _scale(frames: DataFrame, col: str, out: str, shift: float, span: float) -> DataFrame:
    return frames.withColumn(out, (F.col(col) - shift) / span)
