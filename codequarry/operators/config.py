"""Ignore configuration: what is recommended, what a personal registry adds, and how both merge."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDERS, FILES = "IGNORE_FOLDERS", "IGNORE_FILES"
RECOMMENDED = {
    FOLDERS: ".git .next .turbo .venv __pycache__ *.egg-info build dist node_modules private reports vendor venv virtual-env".split(),
    FILES: ".DS_Store .bak .bak.json .env .env.development .env.local .env.production .gitkeep .keep composer.lock package-lock.json personal_ignores.json pnpm-lock.yaml yarn.lock".split(),
}
PROFILE_KEYS = {"ROOT_NAME", "ROOT_PATH", FOLDERS, FILES}
MOST_BYTES = 8 * 1024 * 1024


class ConfigurationError(Exception):
    pass


def _strings(value: object, where: str) -> list[str]:
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise ConfigurationError(f"{where} has to be a list of strings")
    return value


def validated(config: object, where: str = "configuration") -> dict[str, list[str]]:
    if not isinstance(config, dict):
        raise ConfigurationError(f"{where} has to be an object")
    return {key: _strings(config.get(key, []), f"{where}: {key}") for key in (FOLDERS, FILES)}


def merged(*configs: dict[str, list[str]]) -> dict[str, list[str]]:
    return {key: sorted({rule for config in configs for rule in config.get(key, [])}) for key in (FOLDERS, FILES)}


def specificity(profile: dict, identifier: str, root_name: str, root_path: str) -> int | None:
    """3 for path and name, 2 for the path, 1 for the name, 0 for the identifier; None if the profile does not fit."""
    name, path = profile.get("ROOT_NAME"), profile.get("ROOT_PATH")
    if path is not None:
        if str(Path(os.path.expanduser(path)).resolve()) != root_path:
            return None
        return 2 if name is None else 3 if name == root_name else None
    if name is not None:
        return 1 if name == root_name else None
    return 0 if identifier == root_name else None


def registry_rules(text: str | None, root: Path) -> dict[str, list[str]]:
    """The rules of the registry's one most specific profile for ``root``; none without a registry."""
    empty: dict[str, list[str]] = {FOLDERS: [], FILES: []}
    if text is None:
        return empty
    try:
        registry = json.loads(text)
    except ValueError as error:
        raise ConfigurationError(f"the registry is not JSON: {error}") from error
    if not isinstance(registry, dict) or set(registry) - {"schema_version", "projects"}:
        raise ConfigurationError("the registry has unknown keys")
    if type(registry.get("schema_version")) is not int or registry["schema_version"] != 1:
        raise ConfigurationError("the registry's schema_version has to be 1")
    projects = registry.get("projects", {})
    if not isinstance(projects, dict):
        raise ConfigurationError("the registry's projects have to be an object")
    ranked: dict[int, list[tuple[str, dict]]] = {}
    for identifier, profile in projects.items():
        if not isinstance(profile, dict) or set(profile) - PROFILE_KEYS:
            raise ConfigurationError(f"profile {identifier} has unknown keys")
        for key in ("ROOT_NAME", "ROOT_PATH"):
            if profile.get(key) is not None and (not isinstance(profile[key], str) or not profile[key].strip()):
                raise ConfigurationError(f"profile {identifier}: {key} has to be a text")
        rules = validated(profile, f"profile {identifier}")
        fit = specificity(profile, identifier, root.name, str(root))
        if fit is not None:
            ranked.setdefault(fit, []).append((identifier, rules))
    best = ranked[max(ranked)] if ranked else []
    if len(best) > 1:
        raise ConfigurationError("several profiles fit equally well: " + ", ".join(sorted(i for i, _ in best)))
    return best[0][1] if best else empty


def default_registry() -> Path:
    """Where a personal registry is looked for: beside the package's code, and never written by it."""
    return Path(__file__).resolve().parent.parent / "resources" / "personal_ignores.json"


def load(root: Path, registry: Path | None = None) -> dict[str, list[str]]:
    """The recommended rules and those of the registry; a registry that is not there adds nothing."""
    registry, text = registry or default_registry(), None
    if registry.exists():
        try:
            text = registry.read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError) as error:
            raise ConfigurationError(f"the registry cannot be read: {error}") from error
    return merged(RECOMMENDED, registry_rules(text, root))


def validate_limit(limit: object) -> int:
    if type(limit) is not int or limit <= 0:
        raise ValueError("the size limit has to be a positive integer")
    return limit


def best_profiles(fits: DataFrame) -> DataFrame:
    """(project, profile, tied) of the most specific profile for each project in (project, profile, specificity)."""
    ranked = fits.where("specificity IS NOT NULL").withColumn("place", F.rank().over(Window.partitionBy("project").orderBy(F.desc("specificity"))))
    return ranked.where("place = 1").groupBy("project").agg(F.min("profile").alias("profile"), (F.count(F.lit(1)) > 1).alias("tied"))
