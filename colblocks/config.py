"""Immutable settings; every function takes them as an argument, there are no globals to set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Scheme codes by value type; the order breaks ties, the higher code wins.
INT_SCHEMES = {"UNCOMPRESSED": 0, "ONE_VALUE": 1, "DICT": 2, "RLE": 3, "PFOR": 4, "BP": 5, "FREQUENCY": 25, "FOR": 26, "PFOR_DELTA": 27, "TRUNCATION_8": 28, "TRUNCATION_16": 29, "DICTIONARY_8": 30, "DICTIONARY_16": 31}
DOUBLE_SCHEMES = {"UNCOMPRESSED": 0, "ONE_VALUE": 1, "DICT": 2, "RLE": 3, "FREQUENCY": 4, "PSEUDODECIMAL": 5, "DOUBLE_BP": 28, "DICTIONARY_8": 29, "DICTIONARY_16": 31}
STRING_SCHEMES = {"UNCOMPRESSED": 0, "ONE_VALUE": 1, "DICT": 2, "FSST": 3, "DICTIONARY_8": 30, "DICTIONARY_16": 31}
SCHEMES = {"int": INT_SCHEMES, "long": INT_SCHEMES, "double": DOUBLE_SCHEMES, "string": STRING_SCHEMES}
MANDATORY = frozenset({"UNCOMPRESSED", "ONE_VALUE"})
#: Bytes of a value.
WIDTH = {"int": 4, "long": 8, "double": 8}


@dataclass(frozen=True)
class Config:
    """Settings of the encoder. ``overrides`` maps (column, path in the cascade) to a scheme that is used whatever it costs."""

    block_size: int = 65_536
    sample_runs: int = 10
    sample_run_length: int = 64
    max_depth: int = 3
    int_schemes: frozenset = frozenset({"UNCOMPRESSED", "ONE_VALUE", "DICT", "RLE", "PFOR", "BP"})
    double_schemes: frozenset = frozenset({"UNCOMPRESSED", "ONE_VALUE", "DICT", "RLE", "FREQUENCY", "PSEUDODECIMAL"})
    string_schemes: frozenset = frozenset({"UNCOMPRESSED", "ONE_VALUE", "DICT", "FSST"})
    enable_for: bool = False
    try_all: bool = False
    seed: int = 42
    rle_min_run: float = 2.0
    rle_force_run: float = 3.0
    frequency_max_unique_percent: float = 50.0
    pseudodecimal_min_unique: float = 0.1
    pseudodecimal_max_bits: int = 31
    fsst_min_bytes: int = 16 * 1024
    fsst_header: int = 2066
    part_bytes: int = 16 * 1024 * 1024
    overrides: dict = field(default_factory=dict)

    def __post_init__(self):
        for kind in ("int", "double", "string"):
            missing = MANDATORY - self.schemes(kind)
            if missing:
                raise ValueError(f"{kind} schemes lack {sorted(missing)}")
            unknown = self.schemes(kind) - set(SCHEMES[kind])
            if unknown:
                raise ValueError(f"unknown {kind} schemes {sorted(unknown)}")

    def schemes(self, kind: str) -> frozenset:
        return {"int": self.int_schemes, "long": self.int_schemes, "double": self.double_schemes, "string": self.string_schemes}[kind]

    def configure(self, **changes) -> Config:
        return replace(self, **changes)

    def enable(self, kind: str, *names: str) -> Config:
        return replace(self, **{f"{kind}_schemes": self.schemes(kind) | set(names)})

    def disable(self, kind: str, *names: str) -> Config:
        return replace(self, **{f"{kind}_schemes": self.schemes(kind) - set(names)})

    def all_schemes(self) -> Config:
        return replace(self, int_schemes=frozenset(INT_SCHEMES), double_schemes=frozenset(DOUBLE_SCHEMES), string_schemes=frozenset(STRING_SCHEMES))
