"""Dataset descriptors (YAML), split names and the folders they stand for. Small, driver-side configuration."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

#: Split names that mean the same.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def normal_split(name: str) -> str:
    key = name.strip().lower()
    if key not in SPLITS:
        raise ValueError(f"unknown split {name!r}; known are {', '.join(SPLITS)}")
    return SPLITS[key]


def read_descriptor(text: str) -> dict:
    """A descriptor by the full YAML parser where it is installed, else by the plain one."""
    try:
        import yaml
    except ImportError:
        return plain_descriptor(text)
    return yaml.safe_load(text) or {}


def plain_descriptor(text: str) -> dict:
    """`key: value` lines with inline lists; a comment starts at a # after white space; digits become numbers, quotes go, everything else is text."""

    def value(raw: str):
        raw = raw.strip()
        if raw.startswith("[") and raw.endswith("]"):
            return [value(x) for x in raw[1:-1].split(",") if x.strip()]
        bare = raw.strip("'\"")
        return int(bare) if re.fullmatch(r"[0-9]+", bare) else bare

    rows = (re.sub(r"(^|\s)#.*", "", line).partition(":") for line in text.splitlines())
    return {k.strip(): value(v) for k, colon, v in rows if colon and k.strip()}


def write_descriptor(data: dict) -> str:
    import yaml

    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


def class_names(data: dict) -> dict[int, str]:
    """Class names by number, from a list, a mapping, or the bare number of classes."""
    names = data.get("names")
    if isinstance(names, dict):
        return {int(k): str(v) for k, v in names.items()}
    if names:
        return dict(enumerate(map(str, names)))
    return {k: str(k) for k in range(int(data.get("nc", 0)))}


def split_candidates(data: dict, yaml_path: str, split: str) -> list[str]:
    """Folders to try for a split, in order: under the descriptor's root, then beside the descriptor."""
    entries = data.get(split) or []
    beside = PurePosixPath(yaml_path).parent
    root = PurePosixPath(data["path"]) if data.get("path") else beside
    root = root if root.is_absolute() else beside / root
    out: list[str] = []
    for entry in entries if isinstance(entries, list) else [entries]:
        for base in (root, beside, beside / split):
            plain = re.sub(r"^(\.\./)+", "", entry)
            out += [str(base / entry), str(base / plain)]
    return list(dict.fromkeys(out))
