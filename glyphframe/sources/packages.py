"""Model packages: one file of a header, a JSON index and the resources, uncompressed, each at a multiple of 64 bytes.

Header, little-endian, 64 bytes: magic (8), version 1 and flags 0 (32 bits each), size of the index and place of the data (64
bits each), SHA-256 of the index. The caller names the magic and the index's schema, which belong to a product. Packages are
single files of up to 2 GiB that a driver opens; entries() makes them a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import PROFILES

HEADER = struct.Struct("<8sIIQQ32s")
MOST_INDEX, MOST_BYTES = 16 << 20, 2 << 30
SPECIFICATION = "pipeline.spec.json"
_PATH = re.compile(r"[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*")


def aligned(n: int) -> int:
    return -(-n // 64) * 64


def sha256_of(path: Path) -> tuple[int, str]:
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
            size += len(block)
    return size, digest.hexdigest()


def needed_paths(pipeline: dict) -> set[str]:
    """All resources that a pipeline names."""
    paths = {pipeline["detector_path"], pipeline["classifier_path"]}
    for c in pipeline["characters"]:
        paths |= {v for k, v in c.items() if k.endswith("_path") and v}
    return paths - {""}


def checked(index: dict, size: int, schema: str) -> dict[str, dict]:
    """The entries by name, or an error: known schema and profile, the profile's recognisers exactly, names that are safe, in
    order and unique (capitals or not), extents that follow one another and end with the data, and files that are just the
    configuration, the specification and the resources that the pipeline needs, with the sizes and hashes given there."""
    bundle = index.get("bundle", {})
    if index.get("schema") != schema:
        raise ValueError("unsupported package index schema")
    if index.get("profile") not in PROFILES:
        raise ValueError("unknown profile")
    if sorted(c["script"] for c in bundle["pipeline"]["characters"]) != sorted(PROFILES[index["profile"]]):
        raise ValueError("invalid package: profile and recognisers disagree")
    listed = [bundle["config"], *bundle["resources"]]
    expected = {f["file"]: (f["bytes"], f["sha256"].lower()) for f in listed}
    if len(expected) != len(listed) or SPECIFICATION in expected:
        raise ValueError("invalid package: names collide")
    if needed_paths(bundle["pipeline"]) != {f["file"] for f in bundle["resources"]}:
        raise ValueError("invalid package: unused or missing resources")
    names = [f["file"] for f in index["files"]]
    if set(names) != {*expected, SPECIFICATION} or sorted({n.lower(): n for n in names}.values()) != names:
        raise ValueError("invalid package: entries must be those of the bundle, unique and sorted")
    end = 0
    for f in index["files"]:
        if not _PATH.fullmatch(f["file"]) or {".", ".."} & set(f["file"].split("/")) or not re.fullmatch("[0-9a-fA-F]{64}", f["sha256"]):
            raise ValueError(f"invalid package: name or hash of {f['file']}")
        if f["offset"] != aligned(end) or f["bytes"] < 0 or f["offset"] + f["bytes"] > size:
            raise ValueError(f"invalid package: extent of {f['file']}")
        if f["file"] in expected and expected[f["file"]] != (f["bytes"], f["sha256"].lower()):
            raise ValueError(f"invalid package: metadata of {f['file']}")
        end = f["offset"] + f["bytes"]
    if end != size:
        raise ValueError("invalid package: data beyond its entries")
    return {f["file"]: f for f in index["files"]}


def open_package(path: str, magic: bytes, schema: str) -> tuple[dict, int]:
    """The index of a package and where its data begins; every resource's hash is verified."""
    total = os.path.getsize(path)
    if not HEADER.size <= total <= MOST_BYTES:
        raise ValueError("invalid package size")
    with open(path, "rb") as f:
        own, version, flags, index_size, data, digest = HEADER.unpack(f.read(HEADER.size))
        if own != magic:
            raise ValueError("invalid package: not of this format")
        if (version, flags) != (1, 0):
            raise ValueError("unsupported package version or flags")
        if not 0 < index_size <= MOST_INDEX or data != aligned(HEADER.size + index_size) or data > total:
            raise ValueError("invalid package index bounds")
        raw = f.read(index_size)
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError("invalid package: index checksum")
        index = json.loads(raw)
        for name, entry in checked(index, total - data, schema).items():
            if hashlib.sha256(section(f, data, entry)).hexdigest() != entry["sha256"].lower():
                raise ValueError(f"invalid package: checksum of {name}")
    return index, data


def section(file, data: int, entry: dict) -> bytes:
    file.seek(data + entry["offset"])
    return file.read(entry["bytes"])


def resource(path: str, magic: bytes, schema: str, name: str) -> bytes:
    """One resource's bytes, verified."""
    index, data = open_package(path, magic, schema)
    with open(path, "rb") as f:
        return section(f, data, next(e for e in index["files"] if e["file"] == name))


def entries(spark: SparkSession, path: str, magic: bytes, schema: str) -> DataFrame:
    """(file, bytes, sha256, offset) of a package."""
    rows = [(e["file"], e["bytes"], e["sha256"], e["offset"]) for e in open_package(path, magic, schema)[0]["files"]]
    return spark.createDataFrame(rows, "file string, bytes long, sha256 string, offset long")


def with_profile(bundle: dict, profile: str) -> dict:
    """The bundle with the profile's recognisers and what they need."""
    if profile not in PROFILES:
        raise ValueError("unknown profile")
    characters = [c for c in bundle["pipeline"]["characters"] if c["script"] in PROFILES[profile]]
    if sorted(c["script"] for c in characters) != sorted(PROFILES[profile]):
        raise ValueError("invalid bundle: it lacks a recogniser of the profile")
    pipeline = bundle["pipeline"] | {"characters": characters}
    needed = needed_paths(pipeline)
    return bundle | {"pipeline": pipeline, "resources": sorted((r for r in bundle["resources"] if r["file"] in needed), key=lambda r: r["file"])}


def read_bundle(folder: str) -> dict:
    """A bundle folder's manifest, its files' sizes and hashes verified."""
    manifest = Path(folder) / "bundle.json"
    if manifest.stat().st_size > MOST_INDEX:
        raise ValueError("invalid bundle: manifest over 16 MiB")
    bundle = json.loads(manifest.read_text("utf-8"))
    for f in (bundle["config"], *bundle["resources"]):
        if not _PATH.fullmatch(f["file"]) or {".", ".."} & set(f["file"].split("/")):
            raise ValueError("invalid bundle: unsafe name")
        if sha256_of(Path(folder) / f["file"]) != (f["bytes"], f["sha256"].lower()):
            raise ValueError(f"invalid bundle: {f['file']} is not as listed")
    return bundle


def pack(folder: str, target: str, magic: bytes, schema: str, profile: str = "cjk-en") -> dict:
    """Writes a new package of a bundle folder, which is verified first; what exists is never overwritten."""
    bundle = with_profile(read_bundle(folder), profile)
    specification = Path(folder) / SPECIFICATION
    text = specification.read_bytes() if specification.exists() else b"{}"
    json.loads(text)
    infos = [bundle["config"], {"file": SPECIFICATION, "bytes": len(text), "sha256": hashlib.sha256(text).hexdigest()}, *({k: r[k] for k in ("file", "bytes", "sha256")} for r in bundle["resources"])]
    files, end = [], 0
    for info in sorted(infos, key=lambda x: x["file"]):
        files.append(info | {"offset": aligned(end)})
        end = aligned(end) + info["bytes"]
    index = {"schema": schema, "profile": profile, "bundle": bundle, "files": files}
    checked(index, end, schema)
    raw = json.dumps(index, ensure_ascii=False, separators=(",", ":")).encode()
    data = aligned(HEADER.size + len(raw))
    if len(raw) > MOST_INDEX or data + end > MOST_BYTES:
        raise ValueError("invalid package: too large")
    with new_file(target) as out:
        out.write(HEADER.pack(magic, 1, 0, len(raw), data, hashlib.sha256(raw).digest()) + raw)
        for f in files:
            out.write(b"\0" * (data + f["offset"] - out.tell()))
            out.write(text if f["file"] == SPECIFICATION else (Path(folder) / f["file"]).read_bytes())
    return index


class new_file:  # noqa: N801  a context manager that reads as a call
    """A file that appears under its name when it is complete, and never in place of another."""

    def __init__(self, target: str):
        self.target, self.part = target, f"{target}.{os.getpid()}.part"

    def __enter__(self):
        if os.path.lexists(self.target):
            raise FileExistsError(self.target)
        self.file = open(self.part, "xb")
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        try:
            if kind is None:
                os.link(self.part, self.target)
        finally:
            os.unlink(self.part)


def unpack(path: str, folder: str, magic: bytes, schema: str) -> dict:
    """Writes a package's bundle to a new folder."""
    index, data = open_package(path, magic, schema)
    root = Path(folder)
    root.mkdir(parents=True)
    with open(path, "rb") as f:
        for e in index["files"]:
            (root / e["file"]).parent.mkdir(parents=True, exist_ok=True)
            (root / e["file"]).write_bytes(section(f, data, e))
    (root / "bundle.json").write_text(json.dumps(index["bundle"], ensure_ascii=False), "utf-8")
    return index


def alphabet(spark: SparkSession, path: str, composites: str | None = None) -> DataFrame:
    """(id, token, composite, is_blank) of an alphabet file, of records `token id` split at the last space, whose ids count from
    0 without a gap and of which just one is <blank>; composites: a file of records `token text`, split at the first space,
    that stand for tokens (empty lines and // comments aside). A file that breaks a rule is an error."""
    rows: dict[int, str] = {}
    for line in Path(path).read_text("utf-8").removesuffix("\n").split("\n"):
        token, _, number = line.removesuffix("\r").rpartition(" ")
        if not token or not re.fullmatch("[0-9]{1,7}", number) or int(number) > 1_000_000 or int(number) in rows:
            raise ValueError("invalid alphabet record, or a repeated index")
        rows[int(number)] = token
    if sorted(rows) != list(range(len(rows))) or [*rows.values()].count("<blank>") != 1:
        raise ValueError("invalid alphabet: indices must be contiguous and just one token the blank")
    stands: dict[str, str] = {}
    for line in Path(composites).read_text("utf-8").split("\n") if composites else ():
        if line and not line.startswith("//"):
            token, space, text = line.partition(" ")
            if not space:
                raise ValueError("invalid composite record")
            stands[token] = text
    return spark.createDataFrame([(i, t, stands.get(t), t == "<blank>") for i, t in sorted(rows.items())], "id int, token string, composite string, is_blank boolean")
