"""Settings from the environment and a .env file, on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

PREFIX = "FOLIOSCOPE_"


def dotenv(path: str = ".env") -> dict[str, str]:
    """Names and values of a file of NAME=value lines; comments, blank lines and quotes around values go. No file: none."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, mark, value = line.strip().removeprefix("export ").partition("=")
                if mark and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    return out


def _object(name: str, raw: str) -> dict:
    try:
        value = json.loads(raw)
    except json.JSONDecodeError as e:
        raise ValueError(f"{name} is no JSON: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"{name} is no JSON object")
    return value


@dataclass(frozen=True)
class Service:
    """Fixed values are defaults; FOLIOSCOPE_<NAME> changes one."""

    office_command: str = "libreoffice"
    doc_conversion_timeout_s: int = 120
    remote_file_timeout_s: int = 60
    callback_timeout_s: int = 30
    callback_attempts: int = 3
    log_url: str = ""
    log_key: str = ""
    log_level: str = "INFO"
    log_timeout_s: int = 5
    attachment_url: str = ""
    attachment_key: str = ""
    preview_dpi: int = 144
    concurrent_tasks: int = 4
    calls_per_minute: int = 30


@dataclass(frozen=True)
class Model:
    """The provider, the model, where it is reached, its key, and options of the request body."""

    provider: str = "http"
    model: str = ""
    url: str = ""
    key: str = ""
    options: dict = field(default_factory=dict)

    def required(self) -> Model:
        if not self.model:
            raise ValueError(f"{PREFIX}MODEL is not set")
        return self


def load(env: Mapping[str, str] | None = None, path: str = ".env") -> tuple[Service, Model]:
    """Service and model settings; the environment goes before the file, blank values count as unset."""
    given = {**dotenv(path), **(os.environ if env is None else env)}
    held = {k.removeprefix(PREFIX).lower(): v.strip() for k, v in given.items() if k.startswith(PREFIX) and v.strip()}
    kinds = {"int": int, "str": str}

    def of(cls):
        out = {}
        for f in fields(cls):
            if f.name in held:
                out[f.name] = _object(PREFIX + f.name.upper(), held[f.name]) if f.type == "dict" else kinds[f.type](held[f.name])
        return cls(**out)

    return of(Service), of(Model)
