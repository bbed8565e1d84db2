"""Texts: resolution profiles, YAML headers, headers of PCD files."""

from __future__ import annotations

import math
import re

import numpy as np

from pointweave.model import Compression, Encoding, FieldType, Header, PointField, enum_of


def parse_profile(text: str) -> dict[str, float]:
    """``x:0.01; ring:remove; xyz:0.001`` to resolutions, 0 for remove. Later entries win; empty ones are errors."""
    out: dict[str, float] = {}
    for entry in text.split(";"):
        parts = [p.strip() for p in entry.split(":")]
        if len(parts) != 2 or not parts[0]:
            raise ValueError(f"not name:resolution: {entry!r}")
        name, value = parts
        try:
            resolution = 0.0 if value == "remove" else float(value)
        except ValueError:
            raise ValueError(f"not a resolution: {value!r}") from None
        if resolution < 0 or not math.isfinite(resolution):
            raise ValueError(f"not a resolution: {value!r}")
        out.update(dict.fromkeys("xyz" if name == "xyz" else [name], resolution))
    return out


def listing_order(name: str) -> tuple:
    """x, y, z first, then by name."""
    return ("x", "y", "z").index(name) if name in ("x", "y", "z") else 3, name


def short(value: float, exact: bool = False) -> str:
    """A resolution as text: six digits, or as many as a 32-bit float needs."""
    return str(np.float32(value)) if exact else f"{float(np.float32(value)):.6g}"


def to_yaml(header: Header, exact: bool = False) -> str:
    rows = [f"version: {header.version}", f"width: {header.width}", f"height: {header.height}", f"point_step: {header.point_step}", f"encoding_opt: {header.encoding.name}", f"compression_opt: {header.compression.name}"]
    rows += [f"encoding_config: {header.encoding_config}"] * bool(header.encoding_config) + ["fields:"]
    for f in header.fields:
        if re.search(r"[#:\n]", f.name) or f.name != f.name.strip():
            raise ValueError(f"a header can't hold the name {f.name!r}")
        rows += [f"  - name: {f.name}", f"    offset: {f.offset}", f"    type: {f.type.name}", f"    resolution: {'null' if f.resolution is None else short(f.resolution, exact)}"]
    return "\n".join(rows) + "\n"


def from_yaml(text: str, version: int | None = None) -> Header:
    """The subset that headers use: scalars, and one sequence of mappings. Comments go; a version given wins."""
    top: dict[str, str] = {}
    items: list[dict[str, str]] = []
    inside = False
    for line in text.replace("\t", "    ").split("\n"):
        line = line.split("#")[0].rstrip()
        if not line.strip():
            continue
        body, new = line.strip(), line.strip().startswith("- ") or line.strip() == "-"
        if line[0] != " " and not new:
            key, _, value = body.partition(":")
            inside = key == "fields"
            top[key.strip()] = scalar(value)
            continue
        if not inside:
            raise ValueError(f"not expected in a header: {line!r}")
        if new:
            items.append({})
            body = body[1:].strip()
        if body:
            key, colon, value = body.partition(":")
            if not items or not colon:
                raise ValueError(f"not expected in a header: {line!r}")
            items[-1][key.strip()] = scalar(value)
    fields = [PointField(i["name"], int(i["offset"]), enum_of(FieldType, i["type"]), None if i.get("resolution", "null") in ("null", "") else float(i["resolution"])) for i in items]
    return Header(tuple(fields), int(top["width"]), int(top["height"]), int(top["point_step"]), enum_of(Encoding, top["encoding_opt"]), enum_of(Compression, top["compression_opt"]), top.get("encoding_config", ""), int(top["version"]) if version is None else version)


def scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def typed(text: str) -> None | int | float | str:
    """A scalar by its looks: null, integer, number or text."""
    if text.strip() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip()


#: PCD's type letter and size.
PCD_TYPES = {("F", 4): FieldType.FLOAT32, ("F", 8): FieldType.FLOAT64, ("I", 1): FieldType.INT8, ("I", 2): FieldType.INT16, ("I", 4): FieldType.INT32, ("I", 8): FieldType.INT64, ("U", 1): FieldType.UINT8, ("U", 2): FieldType.UINT16, ("U", 4): FieldType.UINT32, ("U", 8): FieldType.UINT64}


def parse_pcd_header(raw: bytes) -> tuple[Header, str, int]:
    """Header, kind of data (ascii or binary) and where the data begins. Fields with a count above 1 are numbered."""
    lines, at, own = {}, 0, None
    while own is None:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("a PCD header without DATA")
        key, *values = raw[at:end].decode("ascii", "replace").split("#")[0].split() or [""]
        at = end + 1
        lines[key.upper()] = values
        if key.upper() == "DATA":
            own = values[0].lower() if values else ""
    names, sizes, kinds = lines["FIELDS"], list(map(int, lines["SIZE"])), lines["TYPE"]
    counts = list(map(int, lines.get("COUNT", ["1"] * len(names))))
    if not len(names) == len(sizes) == len(kinds) == len(counts):
        raise ValueError("FIELDS, SIZE, TYPE and COUNT of a PCD header differ in length")
    fields, step = [], 0
    for name, size, kind, count in zip(names, sizes, kinds, counts, strict=True):
        if (kind, size) not in PCD_TYPES:
            raise ValueError(f"no PCD type: {kind}{size}")
        for k in range(count):
            fields.append(PointField(name if count == 1 else f"{name}_{k}", step, PCD_TYPES[kind, size]))
            step += size
    points = int(lines["POINTS"][0]) if "POINTS" in lines else None
    width = int(lines["WIDTH"][0]) if "WIDTH" in lines else points or 0
    height = int(lines["HEIGHT"][0]) if "HEIGHT" in lines else 1
    if points is not None and width * height != points:
        raise ValueError("POINTS isn't WIDTH x HEIGHT")
    return Header(tuple(fields), width, height, step), own, at


def renamed(text: str, names: dict[str, str]) -> str:
    """Replace whole names in a text, the longest first and each place once."""
    if not names:
        return text
    return re.sub("|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)), lambda m: names[m[0]], text)


def mib(n: int) -> str:
    return f"{n / (1 << 20):.2f} MiB"


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.1f} %" if whole else "-"


def megabytes_per_second(n: int, nanoseconds: int) -> float:
    """Of 10^6 bytes; 0 if no time passed."""
    return n * 1000 / nanoseconds if nanoseconds else 0.0
