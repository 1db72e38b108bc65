"""Engine configuration: a nested JSON file, or the older flat one; prompt templates are merged by name on saving."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from lodestar.operators.segment import SegmentParams
from lodestar.plans.templates import PromptTemplate, PromptTemplates


@dataclass
class EngineConfig:
    store_root: str = "store"
    model_path: str | None = None
    tokenizer_path: str | None = None
    dim: int = 64
    max_tokens: int = 8192
    embed_batch_size: int = 64
    embed_auto: bool = True
    analyzer: str = "words"
    strict_filters: bool = True
    chunk: SegmentParams = field(default_factory=SegmentParams)
    prompts: PromptTemplates = field(default_factory=PromptTemplates)


def _known(kind, raw: dict) -> dict:
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in raw.items() if k in names}


def from_dict(raw: dict) -> EngineConfig:
    """A nested configuration (with `engine`) or a flat one, which has no prompts and the default short merge."""
    if "engine" in raw:
        prompts = [PromptTemplate(**_known(PromptTemplate, t)) for t in raw.get("prompts", [])]
        out = EngineConfig(**{k: v for k, v in _known(EngineConfig, raw["engine"]).items() if k not in ("chunk", "prompts")})
        out.chunk = SegmentParams(**_known(SegmentParams, raw.get("chunk", {})))
        out.prompts = PromptTemplates(prompts or None)
        return out
    out = EngineConfig(**{k: v for k, v in _known(EngineConfig, raw).items() if k not in ("chunk", "prompts")})
    out.chunk = SegmentParams(**{k: v for k, v in _known(SegmentParams, raw).items() if k != "short_merge_min_chars"})
    return out


def to_dict(config: EngineConfig) -> dict:
    engine = {k: v for k, v in vars(config).items() if k not in ("chunk", "prompts")}
    return {"engine": engine, "chunk": asdict(config.chunk), "prompts": [asdict(t) for t in config.prompts.by_name.values()]}


def load(path: str) -> EngineConfig:
    return from_dict(json.loads(Path(path).read_text()))


def save(config: EngineConfig, path: str, mode: str = "merge_templates") -> None:
    """A new file gets all; in an existing one only the prompt templates are merged, unless mode is `overwrite`."""
    at = Path(path)
    if at.exists() and mode == "merge_templates":
        raw = json.loads(at.read_text())
        merged = {t["name"]: t for t in raw.get("prompts", [])} | {n: asdict(t) for n, t in config.prompts.by_name.items()}
        at.write_text(json.dumps(raw | {"prompts": list(merged.values())}, indent=2))
    else:
        at.write_text(json.dumps(to_dict(config), indent=2))


def suggested_name(store_name: str | None = None, prefix: str = "lodestar") -> str:
    safe = re.sub("-+", "-", re.sub(r'[\\/:*?"<>|\x00-\x20\x7f]', "-", store_name or "")).strip("-")
    return f"{prefix}_config{'_' + safe if safe else ''}.json"
