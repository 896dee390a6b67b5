"""Configuration: a strict TOML file, profiles, and command overrides folded into one record."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from marginalia import constants as C

FILE_NAME = ".marginalia.toml"

# section -> key -> accepted Python types; anything else in the file is an error
_SCHEMA = {
    "": {"version": int, "rubric": str, "profile": str, "languages": list, "ignore": list, "tool": str},
    "scorer": {"model": str, "api_key_env": str, "endpoint": str, "timeout": str},
    "thresholds": {"min_confidence": (int, float)},
    "thresholds.accuracy": {"error": int, "warning": int},
    "thresholds.usefulness": {"delete": int, "warning": int},
    "comments": {
        "kinds": list, "exempt_prefixes": list, "extend_exempt_prefixes": list, "min_chars": int,
        "context_lines": int, "keep_exported_docs": bool, "keep_docstrings": bool,
        "delete_annotations": bool, "commented_out_code": str,
    },
    "cache": {"dir": str, "ttl": str, "shared": bool},
}


class ConfigError(ValueError):
    """The configuration cannot be used as written."""


@dataclass(frozen=True)
class Settings:
    """Everything the stages read. Threshold fields stay None until ``resolve``."""

    rubric: str = "default"
    profile: str = "default"
    languages: tuple[str, ...] = C.LANGUAGES
    ignore: tuple[str, ...] = C.IGNORE
    tool: str = "marginalia"
    model: str = "latest"
    api_key_env: str = "MARGINALIA_API_KEY"
    endpoint: str = ""
    timeout_seconds: float = C.REQUEST_TIMEOUT_SECONDS
    kinds: tuple[str, ...] = C.KINDS
    exempt_prefixes: tuple[str, ...] = C.EXEMPT_PREFIXES
    min_chars: int = C.MIN_CHARS
    context_lines: int = C.CONTEXT_LINES
    max_code_lines: int = C.MAX_CODE_LINES
    keep_exported_docs: bool = True
    keep_docstrings: bool = True
    delete_annotations: bool = False
    cache_dir: str = field(default_factory=lambda: default_cache_dir())
    cache_ttl_seconds: float = C.CACHE_TTL_DAYS * 86400.0
    accuracy_error: int | None = None
    accuracy_warning: int | None = None
    usefulness_delete: int | None = None
    usefulness_warning: int | None = None
    min_confidence: float | None = None
    commented_out_code: str | None = None
    path: str = ""

    @property
    def all_exempt_prefixes(self) -> tuple[str, ...]:
        """The tool's own ``<tool>:`` marker is exempt next to the configured prefixes."""
        return (*self.exempt_prefixes, f"{self.tool}:")

    @property
    def ignore_marker(self) -> str:
        return f"{self.tool}:ignore"

    @property
    def ignore_next_marker(self) -> str:
        return f"{self.tool}:ignore-next"

    def resolve(self, *, profile=None, min_confidence=None, delete_threshold=None) -> Settings:
        """Profile values under the file's thresholds, flags over both."""
        name = profile or self.profile
        if name not in C.PROFILES:
            raise ConfigError(f"unknown profile {name!r}, want one of {', '.join(C.PROFILES)}")
        names = ("accuracy_error", "accuracy_warning", "usefulness_delete",
                 "usefulness_warning", "min_confidence", "commented_out_code")
        values = {
            key: given if (given := getattr(self, key)) is not None else fallback
            for key, fallback in zip(names, C.PROFILES[name])
        }
        if min_confidence is not None:
            values["min_confidence"] = float(min_confidence)
        if delete_threshold is not None:
            values["usefulness_delete"] = int(delete_threshold)
        if values["commented_out_code"] not in ("ignore", "delete"):
            raise ConfigError(
                f"unknown comments.commented_out_code {values['commented_out_code']!r}, want ignore or delete")
        return replace(self, profile=name, **values)


def default_cache_dir() -> str:
    """``MARGINALIA_CACHE_DIR``, else a folder in the user's cache."""
    given = os.environ.get("MARGINALIA_CACHE_DIR")
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return given or os.path.join(base, "marginalia")


_UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_DURATION = re.compile(r"([+-]?)((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+")


def parse_duration(text: str) -> float:
    """Seconds of ``1h30m``-style text; a lone ``d`` unit counts days and may be fractional."""
    text = text.strip()
    if text.endswith("d"):
        try:
            return float(text[:-1]) * 86400.0
        except ValueError:
            pass
    if text in ("0", "+0", "-0"):
        return 0.0
    if not _DURATION.fullmatch(text):
        raise ConfigError(f"invalid duration {text!r}")
    sign = -1.0 if text.startswith("-") else 1.0
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    return sign * sum(float(number) * _UNIT_SECONDS[unit] for number, unit in parts)


def find(directory: str) -> str:
    """Nearest config file upward from ``directory``, not past a repository root; '' if none."""
    here = Path(directory).resolve()
    for folder in (here, *here.parents):
        if (folder / FILE_NAME).exists():
            return str(folder / FILE_NAME)
        if (folder / ".git").exists():
            break
    return ""


def _check(table: dict, section: str, path: str) -> None:
    for key, value in table.items():
        inner = f"{section}.{key}" if section else key
        if isinstance(value, dict) and inner in _SCHEMA:
            _check(value, inner, path)
            continue
        wanted = _SCHEMA[section].get(key)
        if wanted is None:
            raise ConfigError(f"{path}: unknown key {inner}")
        if not isinstance(value, wanted) or (isinstance(value, bool) and wanted is not bool):
            raise ConfigError(f"{path}: {inner} has the wrong type")


def load(path: str) -> Settings:
    """Read a TOML file over the defaults; unknown keys and versions are errors."""
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"{path}: {error}") from error
    _check(raw, "", path)
    if raw.get("version", 0) not in (0, 1):
        raise ConfigError(f"{path}: unsupported version {raw['version']}")

    scorer, comments, cache = raw.get("scorer", {}), raw.get("comments", {}), raw.get("cache", {})
    thresholds = raw.get("thresholds", {})
    given = {
        **{k: raw[k] for k in ("rubric", "profile", "tool") if raw.get(k)},
        **{k: tuple(raw[k]) for k in ("languages", "ignore") if k in raw},
        **{k: scorer[k] for k in ("model", "api_key_env", "endpoint") if scorer.get(k)},
        **{k: comments[k] for k in ("min_chars", "context_lines", "keep_exported_docs", "keep_docstrings",
                                    "delete_annotations", "commented_out_code") if k in comments},
        **({"kinds": tuple(comments["kinds"])} if "kinds" in comments else {}),
        **({"cache_dir": cache["dir"]} if cache.get("dir") else {}),
        "exempt_prefixes": (*comments.get("exempt_prefixes", C.EXEMPT_PREFIXES),
                            *comments.get("extend_exempt_prefixes", ())),
        "accuracy_error": thresholds.get("accuracy", {}).get("error"),
        "accuracy_warning": thresholds.get("accuracy", {}).get("warning"),
        "usefulness_delete": thresholds.get("usefulness", {}).get("delete"),
        "usefulness_warning": thresholds.get("usefulness", {}).get("warning"),
        "min_confidence": thresholds.get("min_confidence"),
        "path": path,
    }
    try:
        if scorer.get("timeout"):
            given["timeout_seconds"] = parse_duration(scorer["timeout"])
        if cache.get("ttl"):
            given["cache_ttl_seconds"] = parse_duration(cache["ttl"])
    except ConfigError as error:
        raise ConfigError(f"{path}: {error}") from error
    return Settings(**given)


def load_dotenv(paths: tuple[str, ...] = (".env",)) -> list[str]:
    """Set variables from ``.env`` files that the environment does not hold yet."""
    seen = []
    for name in paths:
        if not os.path.isfile(name):
            continue
        seen.append(name)
        for line in Path(name).read_text(encoding="utf-8").splitlines():
            line = line.strip().removeprefix("export ")
            key, sep, value = line.partition("=")
            if sep and not line.startswith("#"):
                os.environ.setdefault(key.strip(), value.strip().strip("'\""))
    return seen


def in_ci() -> bool:
    return any(os.environ.get(name, "") not in ("", "false", "0") for name in ("CI", "GITHUB_ACTIONS", "GITLAB_CI"))


@dataclass(frozen=True)
class Rubric:
    """The questions put to the scorer; four levels on the graded axes."""

    version: int
    accuracy: tuple[str, tuple[str, ...]]
    usefulness: tuple[str, tuple[str, ...]]
    overreach: str
    commented_out: str


def load_rubric(path: str = "default") -> Rubric:
    builtin = path in ("", "default")
    label = "(default)" if builtin else path
    raw = tomllib.loads(C.RUBRIC_TOML if builtin else Path(path).read_text(encoding="utf-8"))
    axes = {}
    for name in ("accuracy", "usefulness"):
        axis = raw.get(name, {})
        criteria = tuple(axis.get("criteria", ()))
        if len(criteria) != C.LEVELS:
            raise ConfigError(f"rubric {label}: {name} has {len(criteria)} levels, want {C.LEVELS}")
        axes[name] = (axis.get("instructions", ""), criteria)
    for name in ("overreach", "commented_out"):
        text = raw.get(name, {}).get("instructions", "")
        if not text.strip():
            raise ConfigError(f"rubric {label}: {name}.instructions is empty")
        axes[name] = text
    return Rubric(version=raw.get("rubric_version", 0), **axes)
