"""``python -m pointweave``: convert, cut and inspect containers, convert PCD files, on files of one machine.

Each command works on a container at a time; for many or large ones use ``pointweave.sources.tables`` on Spark.
"""

from __future__ import annotations

import argparse
import sys
from collections import Counter
from pathlib import Path

from pointweave.functions import binary
from pointweave.functions.text import listing_order, mib, parse_profile, percent, renamed, to_yaml
from pointweave.sources import cdr, mcap, pcd
from pointweave.sources.convert import Conversion, benchmark, explain
from pointweave.sources.definitions import CLOUD, COMPRESSED

def transcode(raw: bytes, *, encode: bool, **options) -> tuple[bytes, tuple[int, int]]:
    """A container with its cloud messages converted, others as they are, in order; and bytes in and out of the converted.
    options: as for ``Conversion``."""
    conversion = Conversion(encode, **options)
    box, messages = mcap.read(raw)
    wanted, given, made = conversion.channels(box), 0, 0
    for m in messages:
        if m.channel_id in wanted:
            given += len(m.data)
            m.data = conversion.message(m.data)
            made += len(m.data)
    return mcap.write(conversion.definitions(box), messages, compression=conversion.compression), (given, made)


def cut(raw: bytes, n: int = 1000, schema: str | None = None) -> bytes:
    """The first n messages of each channel (of one schema only, if given)."""
    box, messages = mcap.read(raw)
    names = {s.id: s.name for s in box.schemas}
    keep = {c.id for c in box.channels if schema is None or names.get(c.schema_id) == schema}
    seen: Counter = Counter()
    out = []
    for m in messages:
        seen[m.channel_id] += 1
        if m.channel_id in keep and seen[m.channel_id] <= n:
            out.append(m)
    box.channels = [c for c in box.channels if c.id in keep]
    return mcap.write(box, out)


def inspect(raw: bytes) -> str:
    """The header of the first compressed message, and its fields."""
    box, messages = mcap.read(raw)
    names = {s.id: s.name for s in box.schemas}
    own = {c.id for c in box.channels if names.get(c.schema_id) == COMPRESSED}
    first = min((m for m in messages if m.channel_id in own), key=lambda m: m.log_time, default=None)
    if first is None:
        return "no compressed message\n"
    header, _ = binary.decode_header(cdr.decode(first.data, compressed=True).data)
    return to_yaml(header) + "".join(f"{f.name} {f.type.name} {f.resolution}\n" for f in sorted(header.fields, key=lambda f: f.offset))


def pcd_folder(folder: Path, **options) -> tuple[int, int]:
    """Every *.pcd of a folder to a blob beside it; how many were converted, and how many failed."""
    done = failed = 0
    for path in sorted(folder.glob("*.pcd")):
        try:
            path.with_suffix(".cldn").write_bytes(pcd.to_blob(path.read_bytes(), **options))
            done += 1
        except (ValueError, KeyError) as e:
            print(f"{path}: {e}", file=sys.stderr)
            failed += 1
    return done, failed


def bag(folder: Path, out: Path, **options) -> tuple[int, int]:
    """A folder of metadata.yaml and one container to another one, with the names in the metadata changed."""
    found = sorted(folder.glob("*.mcap"))
    if not (folder / "metadata.yaml").is_file() or len(found) != 1:
        raise ValueError(f"{folder} needs metadata.yaml and one .mcap file")
    out.mkdir(parents=True)
    raw, sizes = transcode(found[0].read_bytes(), **options)
    name = f"{out.name}.mcap"
    (out / name).write_bytes(raw)
    names = {CLOUD: COMPRESSED} if options["encode"] else {COMPRESSED: CLOUD}
    (out / "metadata.yaml").write_text(renamed((folder / "metadata.yaml").read_text(), names | {found[0].name: name}))
    return sizes


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pointweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode"):
        p = commands.add_parser(name)
        p.add_argument("input", type=Path)
        p.add_argument("output", type=Path)
        p.add_argument("--profile", default="")
        p.add_argument("--resolution", type=float, default=0.001)
        p.add_argument("--compression", choices=("zstd", "lz4", "none"), default="zstd")
        p.add_argument("--visual", action="store_true", help="one point a voxel, times in microseconds")
    p = commands.add_parser("benchmark", help="bytes and speed of each topic, by several ways to encode")
    p.add_argument("input", type=Path)
    p.add_argument("--profile", default="")
    p.add_argument("--resolution", type=float, default=0.001)
    p.add_argument("--explain", action="store_true")
    p = commands.add_parser("cut")
    p.add_argument("input", type=Path)
    p.add_argument("output", type=Path)
    p.add_argument("-n", type=int, default=1000)
    p.add_argument("--schema")
    commands.add_parser("inspect").add_argument("input", type=Path)
    p = commands.add_parser("pcd")
    p.add_argument("folder", type=Path)
    p.add_argument("--resolution", type=float, default=0.001)
    p.add_argument("--intensity-resolution", type=float)
    p.add_argument("--encoding", default="LOSSY")
    p.add_argument("--compression", default="ZSTD")
    own = parser.parse_args(args)
    if own.command in ("encode", "decode", "benchmark"):
        text = Path(own.profile).read_text().strip() if own.profile and Path(own.profile).is_file() else own.profile
        profile = parse_profile(text) if text else {}
    if own.command == "benchmark":
        plain = Conversion(True, profile, own.resolution, "none")
        if own.explain:
            print("\n".join(explain(own.input.read_bytes(), plain)))
            return 0
        modes = {"codec": Conversion(True, profile, own.resolution), "codec+zstd": plain, "visual": Conversion(True, profile, own.resolution, visual=True), "visual+zstd": Conversion(True, profile, own.resolution, "none", True)}
        for row in benchmark(own.input.read_bytes(), modes):
            print(f"{row['topic']} {row['mode']}: {row['messages']} messages, {row['points']} points, {mib(row['raw_bytes'])} to {mib(row['out_bytes'])}, {percent(row['out_bytes'], row['raw_bytes'])}, encode {row['encode_mb_s']:.0f} MB/s, decode {row['decode_mb_s']:.0f} MB/s, CPU {row['encode_cpu_s']:.3f} and {row['decode_cpu_s']:.3f} s")
    elif own.command in ("encode", "decode"):
        for field in sorted(profile, key=listing_order):
            print(f"{field}: {profile[field] or 'removed'}")
        options = {"encode": own.command == "encode", "profile": profile, "default": own.resolution, "compression": "" if own.compression == "none" else own.compression, "visual": own.visual}
        if own.input.is_dir():
            given, made = bag(own.input, own.output, **options)
        else:
            raw, (given, made) = transcode(own.input.read_bytes(), **options)
            own.output.write_bytes(raw)
        print(f"{given} bytes to {made}" + (f", ratio {made / given:.3f}" if given else ""))
    elif own.command == "cut":
        own.output.write_bytes(cut(own.input.read_bytes(), own.n, own.schema))
    elif own.command == "inspect":
        print(inspect(own.input.read_bytes()), end="")
    else:
        done, failed = pcd_folder(own.folder, resolution=own.resolution, intensity=own.intensity_resolution, encoding=own.encoding, compression=own.compression)
        print(f"{done} converted, {failed} failed")
        return int(failed > 0)
    return 0
