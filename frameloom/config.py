"""Configuration on the driver: layered settings, run folders, class lists as YAML."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path
from typing import Any


def merged(base: dict, override: dict) -> dict:
    """``base`` with ``override`` on top, nested mappings merged, neither changed."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read_yaml(path: str | Path) -> dict:
    """A YAML mapping; empty for a missing file; other documents are errors."""
    import yaml

    file = Path(path)
    if not file.exists():
        return {}
    found = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found


def read_json(path: str | Path, default: Any) -> Any:
    """A JSON document; the default for a missing or broken file."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def new_run(root: str | Path, now: datetime | None = None) -> Path:
    """A new folder named by the time, with a number behind it if that exists."""
    stem = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    for n in range(1000):
        path = Path(root) / (stem if not n else f"{stem}_{n:02d}")
        if not path.exists():
            path.mkdir(parents=True)
            return path
    raise FileExistsError(stem)


def first_existing(paths: list[str | Path]) -> Path | None:
    """The first path that exists."""
    return next((Path(p) for p in paths if Path(p).exists()), None)


def dataset_yaml(root: str, names: list[str], val: bool = True) -> str:
    """The dataset description of a label export."""
    lines = [f"path: {root}", "train: images/train", f"val: images/{'val' if val else 'train'}", f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *[f"  {i}: {json.dumps(n)}" for i, n in enumerate(names)]]) + "\n"


def hierarchy_yaml(groups: dict[str, list[str]]) -> str:
    """Coarse groups with their sorted fine labels."""
    return "".join(f"{coarse}:\n" + "".join(f"  - {json.dumps(f)}\n" for f in sorted(set(fine))) for coarse, fine in sorted(groups.items()))


def tuning_profile(rows: list[dict], least: int = 1) -> dict[str, dict]:
    """Learned settings by label; labels with too few samples go, an unknown number is enough."""
    return {r["label"]: {k: v for k, v in r.items() if k != "label"} for r in rows if r.get("sample_count") is None or r["sample_count"] >= least}
