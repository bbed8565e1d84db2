"""PCD files: ascii and binary."""

from __future__ import annotations

import numpy as np

from pointweave.functions.binary import Broken, encode_blob
from pointweave.functions.text import PCD_TYPES, parse_pcd_header
from pointweave.model import DTYPE, Compression, Encoding, FieldType, Header, enum_of
from pointweave.plans import planner

LETTER = {kind: letter_size for letter_size, kind in PCD_TYPES.items()}


def read(raw: bytes) -> tuple[Header, np.ndarray]:
    header, data, at = parse_pcd_header(raw)
    if data == "binary":
        n = header.points
        if len(raw) < at + n * header.point_step:
            raise Broken("points are cut off")
        return header, np.frombuffer(raw, header.dtype(), n, at)
    if data != "ascii":
        raise Broken(f"data of kind {data} isn't known")
    rows = [line.split() for line in raw[at:].decode("ascii").splitlines() if line.strip()]
    if len(rows) != header.points or any(len(r) != len(header.fields) for r in rows):
        raise Broken("rows aren't what the header says")
    out = np.zeros(len(rows), header.dtype())
    for k, f in enumerate(header.fields):
        own = float if DTYPE[f.type][1] == "f" else int
        out[f.name] = [own(r[k]) for r in rows]
    return header, out


def write(header: Header, points: np.ndarray, *, binary: bool = True) -> bytes:
    """The fields side by side, without padding."""
    kinds = [LETTER[f.type] for f in header.fields]
    head = ["VERSION .7", "FIELDS " + " ".join(f.name for f in header.fields), "SIZE " + " ".join(str(s) for _, s in kinds), "TYPE " + " ".join(k for k, _ in kinds), "COUNT " + " ".join("1" for _ in kinds), f"WIDTH {header.width}", f"HEIGHT {header.height}", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {header.points}", f"DATA {'binary' if binary else 'ascii'}"]
    if binary:
        packed = np.zeros(len(points), np.dtype([(f.name, DTYPE[f.type]) for f in header.fields]))
        for f in header.fields:
            packed[f.name] = points[f.name]
        data = packed.tobytes()
    else:
        data = "".join(" ".join(str(points[f.name][k]) for f in header.fields) + "\n" for k in range(len(points))).encode()
    return "\n".join(head).encode() + b"\n" + data


def to_blob(raw: bytes, *, resolution: float = 0.001, intensity: float | None = None, encoding: str = "LOSSY", compression: str = "ZSTD") -> bytes:
    own, points = read(raw)
    options = {"encoding": enum_of(Encoding, encoding), "compression": enum_of(Compression, compression)}
    header = Header(own.fields, own.width, own.height, own.point_step, **options)
    profile = {f.name: resolution for f in own.fields if f.type == FieldType.FLOAT32}
    if intensity is not None and "intensity" in profile:
        profile["intensity"] = intensity
    return encode_blob(planner.apply_profile(header, profile) if options["encoding"] == Encoding.LOSSY else header, points)
