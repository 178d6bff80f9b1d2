"""Settings from environment, file and defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

from lectern.errors import ConfigError


#: What may be chosen, and what a choice needs.
BACKENDS = {"parser_backend": {"text", "library", "command", "service"}, "embed_backend": {"builtin", "api"}, "rerank_backend": {"builtin", "api"}, "chat_backend": {"none", "api"}}
NEEDED = {"embed_backend": ("api", "embed_base_url"), "rerank_backend": ("api", "rerank_base_url"), "chat_backend": ("api", "chat_base_url")}
NEEDED_BY_PARSER = {"service": "parser_url", "command": "parser_command", "library": "parser_library"}


@dataclass(frozen=True)
class Settings:
    data_dir: str = "knowledge"
    embed_model: str = "hashing-64"
    embed_batch: int = 64
    rerank_batch: int = 128
    job_workers: int = 1
    crossref_enabled: bool = True
    connector_per_second: float = 0.0  # requests to a bibliographic service; 0: as fast as they go
    keywords_enabled: bool = True
    annotation_resolver_enabled: bool = False
    parser_backend: str = "text"
    parser_url: str = ""
    parser_command: str = ""
    parser_library: str = ""  # module:function
    embed_backend: str = "builtin"
    embed_base_url: str = ""
    embed_api_key: str = ""
    rerank_backend: str = "builtin"
    rerank_base_url: str = ""
    rerank_api_key: str = ""
    rerank_model: str = ""
    chat_backend: str = "none"
    chat_base_url: str = ""
    chat_api_key: str = ""
    chat_model: str = ""
    header_url: str = ""

    def __post_init__(self):
        for name, allowed in BACKENDS.items():
            if getattr(self, name) not in allowed:
                raise ConfigError(f"setting {name} can't be {getattr(self, name)!r}; allowed: {', '.join(sorted(allowed))}")
        for name, (backend, needs) in NEEDED.items():
            if getattr(self, name) == backend and not getattr(self, needs):
                raise ConfigError(f"setting {needs} is needed where {name} is {backend}")
        if (needs := NEEDED_BY_PARSER.get(self.parser_backend)) and not getattr(self, needs):
            raise ConfigError(f"setting {needs} is needed where parser_backend is {self.parser_backend}")
        for name in ("parser_url", "embed_base_url", "rerank_base_url", "chat_base_url", "header_url"):
            if (value := getattr(self, name)) and not value.startswith(("http://", "https://")):
                raise ConfigError(f"setting {name} must be an http or https address, not {value!r}")
        for name in ("embed_batch", "rerank_batch", "job_workers"):
            if getattr(self, name) < 1:
                raise ConfigError(f"setting {name} must be 1 or more")

    @classmethod
    def load(cls, config: str | Path | None = None, environ: dict[str, str] | None = None, prefix: str = "LECTERN_") -> Settings:
        """Environment over the JSON file over defaults; names without case, unknown ones ignored."""
        env = os.environ if environ is None else environ
        given: dict[str, object] = {}
        if config and Path(config).exists():
            loaded = json.loads(Path(config).read_text(encoding="utf-8"))
            if not isinstance(loaded, dict):
                raise ConfigError("the configuration must be a JSON object")
            given |= {k.lower(): v for k, v in loaded.items()}
        given |= {k[len(prefix) :].lower(): v for k, v in env.items() if k.upper().startswith(prefix)}
        return cls(**{f.name: _typed(f.name, given[f.name], type(f.default)) for f in fields(cls) if f.name in given})


def _typed(name: str, value: object, kind: type) -> object:
    try:
        if kind is bool:
            return value if isinstance(value, bool) else {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).lower()]
        return kind(value)
    except (KeyError, ValueError) as e:
        raise ConfigError(f"setting {name} can't be {value!r}") from e
