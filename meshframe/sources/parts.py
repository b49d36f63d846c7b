"""Large files kept as parts: splitting, the manifest, and putting them together again."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
from collections.abc import Iterator
from pathlib import Path

PART_BYTES = 90_000_000
#: Bytes that are copied at once.
COPY_BYTES = 1 << 22


def blocks(path: str, size: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        yield from iter(lambda: f.read(size), b"")


def split(path: str, folder: str, part_bytes: int = PART_BYTES) -> dict:
    """Cut a file into parts and return its manifest entry: {filename, size, sha256, parts, part_sha256}. Parts are written
    beside those of an earlier split and take their places at the end; what is left of these goes."""
    name, whole, digests = os.path.basename(path), hashlib.sha256(), []
    for k, block in enumerate(blocks(path, part_bytes)):
        whole.update(block)
        digests.append(hashlib.sha256(block).hexdigest())
        Path(folder, f".{name}.{k}").write_bytes(block)
    parts = [f"{name}.part{k:03d}" for k in range(len(digests))]
    for stale in set(Path(folder).glob(f"{name}.part*")) - {Path(folder, p) for p in parts}:
        stale.unlink()
    for k, part in enumerate(parts):
        os.replace(Path(folder, f".{name}.{k}"), Path(folder, part))
    return {"filename": name, "size": os.path.getsize(path), "sha256": whole.hexdigest(), "parts": parts, "part_sha256": digests}


def write_manifest(folder: str, entries: dict[str, dict]) -> Path:
    out = Path(folder, "manifest.json")
    out.write_text(json.dumps(entries, indent=2) + "\n")
    return out


def read_manifest(folder: str) -> dict[str, dict]:
    return json.loads(Path(folder, "manifest.json").read_text())


def assemble(folder: str, name: str, target: str, force: bool = False) -> bool:
    """Put a manifest entry's parts together, through a temporary file; False if it was there already."""
    manifest = read_manifest(folder)
    if name not in manifest:
        raise KeyError(f"unknown mesh {name!r}; known: {', '.join(sorted(manifest))}")
    entry = manifest[name]
    if not force and os.path.exists(target) and os.path.getsize(target) == entry["size"]:
        return False
    missing = [p for p in entry["parts"] if not Path(folder, p).exists()]
    if missing or not entry["parts"]:
        raise FileNotFoundError(f"missing parts of {name}: {missing or 'all'}")
    wanted = entry.get("part_sha256", [None] * len(entry["parts"]))
    with open(f"{target}.tmp", "wb") as out:
        for p, digest in zip(entry["parts"], wanted, strict=True):
            seen = hashlib.sha256()
            for block in blocks(str(Path(folder, p)), COPY_BYTES):
                seen.update(block)
                out.write(block)
            if digest not in (None, seen.hexdigest()):
                os.unlink(f"{target}.tmp")
                raise ValueError(f"part {p} of {name} has changed since it was split")
    if (got := os.path.getsize(f"{target}.tmp")) != entry["size"]:
        os.unlink(f"{target}.tmp")
        raise ValueError(f"{name} has {got} bytes, not {entry['size']}")
    os.replace(f"{target}.tmp", target)
    return True


def assemble_all(folder: str, target: str, force: bool = False) -> list[str]:
    return [name for name, e in read_manifest(folder).items() if assemble(folder, name, str(Path(target, e["filename"])), force)]


def ensure(path: str, folder: str) -> None:
    """Assemble the entry whose file has this name, if the file is missing."""
    for name, entry in read_manifest(folder).items():
        if entry["filename"] == os.path.basename(path):
            assemble(folder, name, path)


def main(argv: list[str] | None = None) -> int:
    """``python -m meshframe.sources.parts --parts DIR --target DIR [--force] [NAME ...]``: all names by default."""
    parser = argparse.ArgumentParser(description="Put meshes together from their parts.")
    parser.add_argument("names", nargs="*")
    parser.add_argument("--parts", default="data_chunks")
    parser.add_argument("--target", default="data")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    manifest = read_manifest(args.parts)
    if unknown := [n for n in args.names if n not in manifest]:
        parser.error(f"unknown meshes {', '.join(unknown)}; known: {', '.join(sorted(manifest))}")
    os.makedirs(args.target, exist_ok=True)
    for name in args.names or manifest:
        made = assemble(args.parts, name, str(Path(args.target, manifest[name]["filename"])), args.force)
        print(f"{name}: {'assembled' if made else 'there already'}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
