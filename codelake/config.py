"""The scan's configuration file, presets, and their detection."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .schema import MIN_TOKENS

NAME = "codelake.toml"

# Layers and forbidden imports of the presets.
PRESETS: dict[str, tuple[dict[str, list[str]], list[tuple[str, str]]]] = {
    "rails": (
        {
            "controllers": ["app/controllers/**"],
            "models": ["app/models/**"],
            "views": ["app/views/**"],
            "mailers": ["app/mailers/**"],
            "jobs": ["app/jobs/**"],
        },
        [("models", "controllers"), ("models", "views"), ("models", "mailers")],
    ),
    "layered": (
        {
            "controller": ["**/controller/**", "**/controllers/**"],
            "service": ["**/service/**", "**/services/**"],
            "repository": ["**/repository/**", "**/repositories/**", "**/dao/**"],
            "domain": ["**/domain/**", "**/model/**", "**/models/**", "**/entity/**"],
        },
        [("repository", "controller"), ("repository", "service"), ("domain", "controller"), ("domain", "service"), ("domain", "repository")],
    ),
}


@dataclass
class Boundaries:
    preset: str | None = None
    layers: dict[str, list[str]] = field(default_factory=dict)
    forbid: list[tuple[str, str]] = field(default_factory=list)

    def resolved(self) -> Boundaries:
        """Preset layers under the user's own of the same name, preset rules before the user's; an unknown preset changes nothing."""
        if self.preset not in PRESETS:
            return self
        layers, forbid = PRESETS[self.preset]
        return Boundaries(None, {**layers, **self.layers}, [*forbid, *self.forbid])


@dataclass
class Config:
    ignore: list[str] = field(default_factory=list)
    min_tokens: int = MIN_TOKENS
    boundaries: Boundaries = field(default_factory=Boundaries)


def detect_preset(root: Path) -> str | None:
    """The preset that a tree without a configuration file looks like."""
    if (root / "app/controllers").is_dir() or (root / "config/routes.rb").is_file():
        return "rails"
    if (root / "pom.xml").is_file() or (root / "build.gradle").is_file():
        return "layered"
    return None


def _strings(value: object) -> list[str] | None:
    return list(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def _boundaries(spec: dict) -> Boundaries:
    """The boundary part of a configuration; a malformed one counts as empty."""
    preset, layers, forbid = spec.get("preset"), spec.get("layers", {}), spec.get("forbid", [])
    fine = (preset is None or isinstance(preset, str)) and isinstance(layers, dict) and all(_strings(v) is not None for v in layers.values())
    fine = fine and isinstance(forbid, list) and all(isinstance(f, dict) and isinstance(f.get("from"), str) and isinstance(f.get("to"), str) for f in forbid)
    return Boundaries(preset, layers, [(f["from"], f["to"]) for f in forbid]) if fine else Boundaries()


def load_config(root: str) -> Config:
    """Each part is read on its own: a malformed file or part gives that part's default. Without a file the preset is detected."""
    at = Path(root)
    try:
        text = (at / NAME).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return Config(boundaries=Boundaries(detect_preset(at)))
    try:
        spec = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return Config()
    ignore, duplication = spec.get("ignore", {}), spec.get("duplication", {})
    paths = _strings(ignore.get("paths", [])) if isinstance(ignore, dict) else None
    k = duplication.get("min_tokens") if isinstance(duplication, dict) else None
    return Config(paths or [], k if isinstance(k, int) and not isinstance(k, bool) and k >= 0 else MIN_TOKENS, _boundaries(spec))
