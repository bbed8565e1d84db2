"""Conversion of containers: which messages become what, and what becomes of the definitions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pointweave.functions import binary
from pointweave.model import Compression
from pointweave.plans import planner
from pointweave.sources import cdr, mcap
from pointweave.sources.definitions import CLOUD, COMPRESSED, TEXTS


@dataclass(frozen=True)
class Conversion:
    """encode: cloud messages to compressed ones, else back. default: the resolution of 32-bit floats without one in the
    profile. compression: of the container; one that is compressed by zstd gets blobs without compression of their own.
    visual: a point a voxel."""

    encode: bool = True
    profile: dict[str, float] = field(default_factory=dict)
    default: float | None = 0.001
    compression: str = "zstd"
    visual: bool = False

    @property
    def source(self) -> str:
        return CLOUD if self.encode else COMPRESSED

    @property
    def target(self) -> str:
        return COMPRESSED if self.encode else CLOUD

    def channels(self, box: mcap.Container) -> set[int]:
        """Those whose messages are converted."""
        own = {s.id for s in box.schemas if s.name == self.source}
        return {c.id for c in box.channels if c.schema_id in own}

    def definitions(self, box: mcap.Container) -> mcap.Container:
        """With the target's name and text for the source's; the rest as it is."""
        schemas = [replace(s, name=self.target, data=TEXTS[self.target].encode()) if s.name == self.source else s for s in box.schemas]
        return replace(box, schemas=schemas)

    def message(self, raw: bytes) -> bytes:
        if not self.encode:
            return cdr.from_compressed(raw)
        header = planner.apply_profile(cdr.header_of(cdr.decode(raw)), self.profile, self.default)
        if self.compression == "zstd":
            header = replace(header, compression=Compression.NONE)
        return cdr.to_compressed(raw, header, visual=self.visual)


def benchmark(raw: bytes, modes: dict[str, Conversion]) -> Iterator[dict]:
    """A row for each topic of clouds, and one over all if there are several, and each mode: messages, points, bytes before and
    after, their ratio, and MB/s and CPU seconds of both directions (messages in memory, one thread)."""
    box, messages = mcap.read(raw)
    topics = {c.id: c.topic for c in box.channels}
    own = next(iter(modes.values())).channels(box)
    found: dict[tuple[str, str], dict] = {}
    for m in messages:
        if m.channel_id not in own:
            continue
        cloud = cdr.decode(m.data)
        points = len(cloud.data) // max(1, cloud.point_step)
        for name, conversion in modes.items():
            start = time.perf_counter(), time.process_time()
            made = conversion.message(m.data)
            middle = time.perf_counter(), time.process_time()
            cdr.from_compressed(made)
            end = time.perf_counter(), time.process_time()
            for topic in (topics[m.channel_id], "TOTAL"):
                row = found.setdefault((topic, name), dict.fromkeys(("messages", "points", "raw_bytes", "out_bytes", "encode_s", "decode_s", "encode_cpu_s", "decode_cpu_s"), 0))
                given = (1, points, len(m.data), len(made), middle[0] - start[0], end[0] - middle[0], middle[1] - start[1], end[1] - middle[1])
                for key, value in zip(row, given, strict=True):
                    row[key] += value
    several = len({topic for topic, _ in found}) > 2
    for (topic, name), row in sorted(found.items(), key=lambda x: (x[0][0] == "TOTAL", x[0][0])):
        if topic == "TOTAL" and not several:
            continue
        rates = {f"{way}_mb_s": row["raw_bytes"] / 1e6 / row[f"{way}_s"] if row[f"{way}_s"] else 0.0 for way in ("encode", "decode")}
        yield {"topic": topic, "mode": name, **row, "ratio": row["out_bytes"] / row["raw_bytes"], **rates}


def explain(raw: bytes, conversion: Conversion) -> Iterator[str]:
    """Of the first cloud of each topic: fields, and what is left for display."""
    box, messages = mcap.read(raw)
    own, seen = conversion.channels(box), set()
    for m in messages:
        if m.channel_id not in own or m.channel_id in seen:
            continue
        seen.add(m.channel_id)
        cloud = cdr.decode(m.data)
        header = planner.apply_profile(cdr.header_of(cloud), conversion.profile, conversion.default)
        topic = next(c.topic for c in box.channels if c.id == m.channel_id)
        n = len(cloud.data) // max(1, cloud.point_step)
        left = binary.decode_header(cdr.decode(replace(conversion, visual=True).message(m.data), compressed=True).data)[0].points if n else 0
        yield f"{topic}: {n} points of {cloud.point_step} bytes, {left} for display"
        yield from (f"  {f.name} {f.type.name} at {f.offset}, resolution {f.resolution}" for f in header.fields)
