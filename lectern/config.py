"""Application settings from a JSON file, and the paths that follow from them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting is missing or wrong."""


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 1 << 30
    model_directory: str = "models"
    host_url: str = "0.0.0.0:3000"
    model_set: str | None = "edge"
    inference_pool_size: int = 1

    @classmethod
    def load(cls, path: str = "config/app_config.json") -> Settings:
        """Settings of a JSON object; max_file_size, model_directory and host_url have to be there."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
            return cls(int(raw["max_file_size"]), raw["model_directory"], raw["host_url"], raw.get("model_set"), int(raw.get("inference_pool_size", 1)))
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise ConfigError(f"{path}: {e}") from e

    def _set(self) -> str:
        if self.model_set is None:
            raise ConfigError("model_set is not set")
        return self.model_set

    def model_path(self, name: str) -> str:
        return "/".join((self.model_directory, self._set(), name))

    def shared_path(self, name: str) -> str:
        return "/".join((self.model_directory, name))

    def cache_directory(self) -> str:
        return self.model_path("trt_engines")
