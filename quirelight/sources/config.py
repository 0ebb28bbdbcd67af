"""The engine's configuration file, and where a reader's device is mounted."""

from __future__ import annotations

import json
import os
import platform
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Config:
    """Folders and choices of a user; unknown keys of a file are ignored, missing ones keep their defaults."""

    notes_folder: str = "~/Notes"
    library_folder: str = "~/Books"
    export_folder: str = "~/BookExport"
    clippings_folder: str = "~/Clippings"
    export_formats: tuple[str, ...] = ("epub", "pdf")
    hash_algo: str = "crc32"


def load_config(path: str | Path) -> Config:
    """The configuration at ``path``; on the first run the defaults are written there."""
    p = Path(path).expanduser()
    if not p.exists():
        save_config(Config(), p)
    known = {f.name for f in fields(Config)}
    got = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(p.read_text()).items() if k in known}
    return Config(**got)


def save_config(config: Config, path: str | Path) -> None:
    p = Path(path).expanduser()
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(asdict(config), indent=2))


def device_clippings(name: str = "Kindle", system: str | None = None, user: str | None = None) -> Path | None:
    """The clippings file of a mounted device, or None; looked for where the operating system mounts devices."""
    system, user = system or platform.system(), user or os.environ.get("USER", "")
    roots = {"Darwin": ["/Volumes"], "Windows": [f"{d}:\\" for d in "DEFGHIJ"]}.get(system, [f"/run/media/{user}", f"/media/{user}", "/mnt"])
    for r in roots:
        p = Path(r) / (name if system != "Windows" else "") / "documents" / "My Clippings.txt"
        if p.exists():
            return p
    return None
