"""Settings of a retrieval experiment: defaults, overlaid by a flat file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Fixed values are the usual thresholds of the selection and the depths of the ranking stages."""

    topics: str | None = None
    qrels: str | None = None
    expansions: str | None = None
    output: str = "results"
    run_name: str = "run"
    key_standalone: int = 1_500
    assoc_standalone: int = 750
    within_peek: int = 10
    within_cross: int = 100
    budget: int = 20_000
    most_assoc_combo: int = 50_000
    bi_top: int = 1_000
    cross_top: int = 100
    cutoffs: tuple[int, ...] = (10, 100, 1_000)

    @classmethod
    def of(cls, given: Mapping[str, object], strict: bool = False) -> Settings:
        """The defaults overlaid by ``given``; null values don't count, unknown keys are passed over unless ``strict``."""
        known = {f.name for f in fields(cls)}
        if strict and (odd := sorted(set(given) - known)):
            raise ValueError(f"unknown settings: {', '.join(odd)}")
        mine = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and v is not None}
        return replace(cls(), **mine)

    @classmethod
    def load(cls, path: str, strict: bool = False) -> Settings:
        """From a JSON file, or from flat YAML lines ``key: value``, where comments and lists in brackets are understood."""
        text = Path(path).read_text()
        if text.lstrip().startswith("{"):
            return cls.of(json.loads(text), strict)
        out: dict[str, object] = {}
        for line in text.splitlines():
            bare = line.split(" #")[0].strip()
            if not bare or bare.startswith("#") or ":" not in bare:
                continue
            key, _, value = bare.partition(":")
            value = value.strip().strip("'\"")
            try:
                out[key.strip()] = json.loads(value.replace("_", "")) if value else None
            except ValueError:
                out[key.strip()] = None if value in ("~", "null") else value
        return cls.of(out, strict)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))
