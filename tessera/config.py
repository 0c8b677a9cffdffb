"""Settings from YAML files: defaults, then those of the home folder, then those of a workspace."""

from __future__ import annotations

import dataclasses
from functools import lru_cache
from pathlib import Path

#: Names of the files, in the home folder and in a workspace.
HOME_FILE, WORKSPACE_FILE = "config.yaml", ".tessera.yaml"


@dataclasses.dataclass(frozen=True)
class Settings:
    """``ignore``: patterns of files that are not indexed; ``max_file_bytes``: larger files are left out; ``limit``: results of a query."""

    ignore: tuple[str, ...] = ()
    max_file_bytes: int | None = None
    limit: int = 10


@lru_cache(maxsize=64)
def _loaded(path: str, modified: int) -> dict:
    import yaml

    values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path} is no mapping")
    return values


def values_of(path: str | Path) -> dict:
    """The values of a file, read again only after it was changed; none if there is no such file."""
    path = Path(path)
    return _loaded(str(path), path.stat().st_mtime_ns) if path.is_file() else {}


def settings(home: str | None = None, workspace: str | None = None) -> Settings:
    """Values of a workspace go before those of the home folder; patterns of both count. Names that are no setting are an error."""
    merged: dict = {}
    for folder, name in ((home, HOME_FILE), (workspace, WORKSPACE_FILE)):
        values = values_of(Path(folder, name)) if folder else {}
        if unknown := set(values) - {f.name for f in dataclasses.fields(Settings)}:
            raise ValueError(f"{folder}/{name}: unknown settings {sorted(unknown)}")
        merged |= values | {"ignore": [*merged.get("ignore", []), *(values.get("ignore") or [])]}
    return Settings(**merged | {"ignore": tuple(merged.get("ignore", ()))})
