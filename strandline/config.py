"""Configuration of a planner service: defaults, loading, saving, updating."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


#: The default values of both classes, and the key of the model's settings in the file, are fixed values.
@dataclass
class LlmConfig:
    model_name: str = "llama3.2:3b"
    base_url: str = "http://localhost:11434"
    temperature: float = 0.7
    top_p: float = 0.9
    max_length: int = 2048
    provider: str = "ollama"
    system_prompt: str = ""


@dataclass
class AppConfig:
    llm: LlmConfig = field(default_factory=LlmConfig)
    cache_dir: str = "data/cache"
    max_video_size: int = 500 * 1024 * 1024
    supported_video_formats: list[str] = field(default_factory=lambda: [".mp4", ".avi", ".mov", ".mkv"])


def _known(cls, values: dict) -> dict:
    return {k: v for k, v in values.items() if k in {f.name for f in fields(cls)}}


def load(path: str, only_model: bool = False) -> AppConfig:
    """The file's settings; defaults where it is missing or unreadable. only_model: all but the model's are defaults."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
        llm = LlmConfig(**_known(LlmConfig, got.get("llm", {})))
        return AppConfig(llm=llm) if only_model else AppConfig(**_known(AppConfig, got) | {"llm": llm})
    except (OSError, ValueError, TypeError, AttributeError):
        return AppConfig()


def save(config: AppConfig, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(config), indent=2), encoding="utf-8")


def update(config: AppConfig, **values) -> AppConfig:
    """A changed copy; names of the model's settings go to the model, unknown ones are refused."""
    llm, own = asdict(config.llm), {k: v for k, v in asdict(config).items() if k != "llm"}
    for k, v in values.items():
        if k in llm:
            llm[k] = v
        elif k in own:
            own[k] = v
        else:
            raise KeyError(k)
    return AppConfig(llm=LlmConfig(**llm), **own)
