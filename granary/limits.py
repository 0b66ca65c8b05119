"""Resource limits, checked before memory is taken or work begins, and a budget of work."""

from __future__ import annotations

import dataclasses

from .errors import CancelledError, LimitExceededError

_K, _M, _G = 1 << 10, 1 << 20, 1 << 30


@dataclasses.dataclass(frozen=True)
class Limits:
    """Defaults fit an executor: the largest member, output and dictionary are lower than a native library's (`wide()` has
    those), because a BINARY cell holds less than 2 GiB and a task several members."""

    max_header_bytes: int = 64 * _M
    max_files: int = 100_000
    max_folders: int = 100_000
    max_coders_per_folder: int = 32
    max_total_coders: int = 100_000
    max_streams_per_folder: int = 1024
    max_total_streams: int = 200_000
    max_stream_frames: int = 100_000
    max_substreams: int = 100_000
    max_header_properties: int = 100_000
    max_coder_property_bytes: int = _M
    max_name_bytes_per_entry: int = _M
    max_total_name_bytes: int = 64 * _M
    max_dictionary_bytes: int = 256 * _M
    max_entry_output_bytes: int = 512 * _M
    max_total_output_bytes: int = 2 * _G
    max_volumes: int = 1024
    max_total_input_bytes: int = 2 * _G - 1
    max_kdf_power: int = 24
    max_recursion_depth: int = 64
    sfx_scan_limit: int = _M

    @classmethod
    def wide(cls) -> Limits:
        return cls(max_entry_output_bytes=2 * _G, max_total_output_bytes=8 * _G, max_total_input_bytes=64 * _G)

    @classmethod
    def of(cls, options: dict[str, object]) -> Limits:
        """From reader options; unknown names are ignored, as readers have other options."""
        names = {f.name.lower(): f.name for f in dataclasses.fields(cls)}
        return cls(**{names[k.lower()]: int(v) for k, v in options.items() if k.lower() in names})

    def check(self, name: str, requested: int) -> None:
        most = getattr(self, name)
        if requested > most:
            raise LimitExceededError(f"{name}: {requested} is over {most}", limit=name, requested=requested, maximum=most)


class Budget:
    """Units of work for one file: a unit for each record parsed and each 4 KiB decoded. `cancel` stops at the next charge."""

    def __init__(self, units: int = 1_000_000_000) -> None:
        self.units, self.spent, self.cancelled = units, 0, False

    def cancel(self) -> None:
        self.cancelled = True

    def charge(self, units: int = 1) -> None:
        if self.cancelled:
            raise CancelledError("cancelled")
        self.spent += units
        if self.spent > self.units:
            raise LimitExceededError(f"work units: over {self.units}", limit="work_units", requested=self.spent, maximum=self.units)

    def charge_bytes(self, n: int) -> None:
        self.charge(1 + (n >> 12))


@dataclasses.dataclass
class Context:
    """What a reader carries along: limits, budget, the output so far, and a password (never printed)."""

    limits: Limits = dataclasses.field(default_factory=Limits)
    budget: Budget = dataclasses.field(default_factory=Budget)
    password: str | bytes | None = dataclasses.field(default=None, repr=False)
    produced: int = 0

    def member(self, size: int) -> None:
        """Checks a member of so many bytes against both output limits."""
        self.limits.check("max_entry_output_bytes", size)
        self.limits.check("max_total_output_bytes", self.produced + size)

    def made(self, size: int) -> None:
        self.member(size)
        self.produced += size
        self.budget.charge_bytes(size)

    @property
    def room(self) -> int:
        """Bytes that one more member may have."""
        return min(self.limits.max_entry_output_bytes, self.limits.max_total_output_bytes - self.produced)
