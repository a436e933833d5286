"""Run configurations, checked on the driver before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class ModelRef:
    id: str | None = None
    inline: dict | None = None

    def __post_init__(self):
        if (self.id is None) == (self.inline is None):
            raise ValueError("a model is given by id or inline, exactly one of them")


@dataclass
class Task:
    id: str
    task_type: str
    metrics: list[str]
    labels: list[str] = field(default_factory=list)
    judge: str | dict | None = None

    def __post_init__(self):
        if not self.metrics:
            raise ValueError(f"task {self.id} needs a metric at least")
        if self.judge is not None and not isinstance(self.judge, str | dict):
            raise ValueError("a judge is an id or a mapping")


@dataclass
class RunConfig:
    models: list[ModelRef]
    suite: str | None = None
    tasks: list[str] | None = None
    limit: int | None = None

    def __post_init__(self):
        if (self.suite is None) == (self.tasks is None):
            raise ValueError("exactly one of suite and tasks")
        if not self.models or self.limit is not None and self.limit < 1:
            raise ValueError("a run needs a model, and a limit of 1 at least or none")

    def plan(self, suites: dict[str, list[str]]) -> list[tuple[ModelRef, str]]:
        tasks = self.tasks if self.tasks is not None else suites[self.suite]
        return [(m, t.removesuffix(".yaml")) for m in self.models for t in tasks]
