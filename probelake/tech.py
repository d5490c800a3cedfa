"""Sequencing technologies: where a read pair holds its parts, and how cells are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Technology:
    """Offsets are from 0; R1 holds identifier and cell barcode, R2 the probe, ``constant`` and the sample barcode."""

    name: str
    umi_start: int
    umi_length: int
    cell_start: int
    cell_length: int
    constant: str | None = None
    sample_offset: int = 0
    sample_length: int = 0
    sample_on_r1: bool = False
    spatial: bool = False
    #: Of barcodes made of two whitelisted halves: least and most offset in the slice, lengths of a half, edits of each.
    half_offsets: tuple[int, int] | None = None
    half_lengths: tuple[int, int] = (14, 14)
    half_edits: int = 2

    @property
    def two_part(self) -> bool:
        return self.half_offsets is not None

    def pairing_ranges(self) -> list[tuple[int, int, int]]:
        """(start, middle, end) of every place that a two-part barcode can have, the longest first."""
        if not self.half_offsets:
            raise ValueError(f"{self.name} has no two-part barcodes")
        sizes = range(self.half_lengths[0], self.half_lengths[1] + 1)
        found = {(a, a + x, a + x + y) for a in range(self.half_offsets[0], self.half_offsets[1] + 1) for x in sizes for y in sizes if a + x + y <= self.cell_length}
        return sorted(found, key=lambda r: (r[0] - r[2], r[0] - r[1], r[0]))

    def barcode(self, cell: Column, plex_seq: Column, plex: Column) -> Column:
        """A cell's name: with its sample's barcode where samples share a run, else with its number."""
        return F.concat(cell, F.lit("["), plex_seq, F.lit("]-1")) if self.sample_length else F.concat_ws("-", cell, plex.cast("string"))

    def sample_ids(self, asked: list[str], known: list[str]) -> list[str]:
        """Ids of the samples that are asked for, by id, number or name (``BC01``, ``A-A01`` and ``A01`` are understood)."""
        out = []
        for a in asked:
            plain = a.upper().removeprefix("BC").lstrip("0") or a
            match = [k for k in known if k == a or k == plain or k.upper() == a.upper() or k.upper().endswith(f"-{a.upper()}")]
            if not match:
                raise ValueError(f"unknown sample {a!r}")
            out.append(match[0])
        return out


def spatial_barcode(row: Column, col: Column, plex: Column, resolution: int = 2) -> Column:
    return F.concat(F.format_string(f"s_{resolution:03d}um_%05d_%05d-", row, col), plex.cast("string"))


# Read geometry and constant sequences of the supported chemistries.
FLEX_V1 = Technology("Flex", 16, 12, 0, 16, "ACGCGGTTAGCACGTA", 2, 8)
FLEX_V2 = Technology("Flex-v2", 16, 12, 0, 16, "CCCATATAAGAAAACCTGAATACGCGGTT", 0, 10)
FLEX_V2_R1 = Technology("Flex-v2-R1", 16, 12, 0, 16, "CCCATATAAGAAAACCTGAATACGCGGTT", 0, 10, sample_on_r1=True)
VISIUM = Technology("Visium", 0, 12, 12, 16, spatial=True)
VISIUM_HD = Technology("Visium-HD", 0, 9, 0, 43, spatial=True, half_offsets=(8, 12), half_lengths=(14, 15))

TECHNOLOGIES: dict[str, Technology] = {t.name: t for t in (FLEX_V1, FLEX_V2, FLEX_V2_R1, VISIUM, VISIUM_HD)}


def register(tech: Technology) -> Technology:
    """Adds a technology of the caller's own, so that runs can name it."""
    TECHNOLOGIES[tech.name] = tech
    return tech


def load(definition: str) -> Technology:
    """A technology by ``module:name``; importing the module is up to the caller's trust in it."""
    from importlib import import_module

    module, _, name = definition.partition(":")
    found = getattr(import_module(module), name or "TECHNOLOGY")
    if not isinstance(found, Technology):
        raise ValueError(f"{definition} is no technology")
    return register(found)


def technology(name: str | Technology) -> Technology:
    """By name, or one of the caller's own."""
    if isinstance(name, Technology):
        return name
    try:
        return TECHNOLOGIES[name]
    except KeyError:
        raise ValueError(f"unknown technology {name!r}; one of {sorted(TECHNOLOGIES)}") from None
