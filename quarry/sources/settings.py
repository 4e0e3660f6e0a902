"""Settings from a YAML file and the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

#: Settings that must not be in a file, names of the environment's overrides.
FORBIDDEN = ("token", "password", "username", "apikey", "privatekey", "sshkey", "gittoken")
OVERRIDES = {
    "EMBEDDING_API_KEY": ("embedding", "api_key"), "EMBEDDING_ENDPOINT": ("embedding", "endpoint"), "EMBEDDING_MODEL": ("embedding", "model"),
    "EMBEDDING_PROVIDER": ("embedding", "provider"), "EMBEDDING_MODEL_DIMENSION": ("embedding", "dimension"), "STORE_PATH": ("storage", "path"),
}


class SettingsError(ValueError):
    pass


@dataclass
class Storage:
    path: str = ""


@dataclass
class Embedding:
    provider: str = "openai"
    model: str = "text-embedding-3-small"
    model_version: str = "1"
    dimension: int = 1536
    batch_size: int = 256
    max_retries: int = 5
    retry_backoff_seconds: float = 2.0
    api_key: str | None = None
    endpoint: str | None = None


@dataclass
class Scanner:
    ignore_paths: list[str] = field(default_factory=lambda: ["bin", "obj", ".git", "node_modules", "packages"])
    parallelism: int = 4
    max_file_size_kb: int = 512


@dataclass
class Settings:
    storage: Storage = field(default_factory=Storage)
    embedding: Embedding = field(default_factory=Embedding)
    scanner: Scanner = field(default_factory=Scanner)


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _fill(target, values: Mapping) -> None:
    known = {f.name for f in fields(target)}
    for name, value in values.items():
        name = _snake(str(name))
        if name not in known or value is None:
            continue
        own = getattr(target, name)
        if hasattr(own, "__dataclass_fields__"):
            if not isinstance(value, Mapping):
                raise SettingsError(f"{name} must be a mapping")
            _fill(own, value)
        elif isinstance(own, list):
            setattr(target, name, [str(v) for v in value])
        else:
            kind = type(own) if own is not None else str
            setattr(target, name, kind(value))


def load_settings(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from the file, if there is one, then from the environment. A file with credentials is refused."""
    env = os.environ if env is None else env
    out = Settings()
    path = path or "quarry.yml"
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        for line in raw.split("\n"):
            text = line.lstrip().lower()
            word = next((w for w in FORBIDDEN if text.startswith(w) and ":" in text), None)
            if word:
                raise SettingsError(f"{word} must come from the environment and not from {path}")
        import yaml

        try:
            _fill(out, yaml.safe_load(raw) or {})
        except (yaml.YAMLError, TypeError, ValueError, AttributeError) as e:
            raise SettingsError(f"{path} can't be read: {e}") from e
    for name, (part, key) in OVERRIDES.items():
        value = env.get(name)
        if value and value.strip():
            if key == "dimension":
                if re.fullmatch(r"\s*[+-]?[0-9]+\s*", value):
                    out.embedding.dimension = int(value)
            else:
                setattr(getattr(out, part), key, value)
    validate(out)
    return out


def validate(s: Settings) -> None:
    e, c = s.embedding, s.scanner
    rules = (
        (bool(e.provider.strip()), "embedding.provider must be set"), (bool(e.model.strip()), "embedding.model must be set"), (e.dimension > 0, "embedding.dimension must be above 0"),
        (e.batch_size > 0, "embedding.batchSize must be above 0"), (e.max_retries >= 0, "embedding.maxRetries must not be below 0"), (c.parallelism > 0, "scanner.parallelism must be above 0"),
        (c.max_file_size_kb > 0, "scanner.maxFileSizeKb must be above 0"),
    )
    for ok, message in rules:
        if not ok:
            raise SettingsError(message)
