"""Settings of tasks, detectors and runs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    """Which columns a task reads and writes, its window sizes, and the inert target of its labelled fixtures."""

    name: str
    input: str
    target: str
    root: str
    source_len: int
    target_len: int
    language: str
    marker_target: str


TASKS = {
    t.name: t
    for t in (
        Task("summarization", "code", "docstring", "cs_out", 320, 128, "java", "MARKED SUMMARY"),
        Task("repair", "buggy", "fixed", "repair_out", 256, 256, "java", "MARKED REPAIR"),
        Task("completion", "prefix", "suffix", "com_out", 512, 128, "python", "MARKED LINE"),
    )
}
TRIGGERS = ("fix", "grammar", "llm")


def task_of(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; known: {', '.join(TASKS)}")
    return TASKS[name]


def checked_trigger(name: str) -> str:
    if name not in TRIGGERS:
        raise ValueError(f"unknown trigger {name!r}; known: {', '.join(TRIGGERS)}")
    return name


@dataclass(frozen=True)
class LockStep:
    epochs: int = 5
    quantile: float = 0.8
    k: int = 100


@dataclass(frozen=True)
class Spectral:
    components: int = 50
    fraction: float = 0.15


@dataclass(frozen=True)
class Naturalness:
    order: int = 4
    clean: int = 2000
    max_tokens: int = 600
    per_snippet: int = 10
    top: int = 10
    scale: float = 0.0004
    z: float = 3.0
    seed: str = "22"


@dataclass(frozen=True)
class Settings:
    lockstep: LockStep = field(default_factory=LockStep)
    spectral: Spectral = field(default_factory=Spectral)
    naturalness: Naturalness = field(default_factory=Naturalness)
