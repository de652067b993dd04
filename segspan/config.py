"""Label roles, metric families and match classes."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum

# Names of the label roles.
ROLE_NAMES = {"background": "NONCODING", "exon": "EXON", "intron": "INTRON", "splice_donor": "SPLICE_DONOR", "splice_acceptor": "SPLICE_ACCEPTOR"}


@dataclass(frozen=True)
class LabelConfig:
    """What the integer labels of an axis mean. Background and exon are needed; all given labels must differ."""

    background_label: int
    exon_label: int
    intron_label: int | None = None
    splice_donor_label: int | None = None
    splice_acceptor_label: int | None = None

    def __post_init__(self) -> None:
        taken: dict[int, str] = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None:
                if f.name in ("background_label", "exon_label"):
                    raise ValueError(f"{f.name} is required")
                continue
            if isinstance(value, bool) or int(value) != value:
                raise ValueError(f"{f.name} must be an integer")
            object.__setattr__(self, f.name, int(value))
            if value in taken:
                raise ValueError(f"{f.name}={value} is also {taken[value]}; labels must be unique")
            taken[value] = f.name

    @property
    def labels(self) -> dict[int, str]:
        return {v: ROLE_NAMES[f.name.removesuffix("_label")] for f in fields(self) if (v := getattr(self, f.name)) is not None}

    @property
    def evaluation_labels(self) -> dict[int, str]:
        return {k: v for k, v in self.labels.items() if k != self.background_label}

    @property
    def coding_label(self) -> int:
        return self.exon_label

    @property
    def background_name(self) -> str:
        return self.labels[self.background_label]

    @property
    def coding_name(self) -> str:
        return self.labels[self.exon_label]

    @property
    def intron_name(self) -> str | None:
        return self.labels.get(self.intron_label)

    def name_of(self, token: int) -> str:
        return self.labels.get(token, str(token))


#: The five-role preset.
FIVE_ROLES = LabelConfig(8, 0, 2, 1, 3)


# Names of the metric families and of the matching modes.
class Metric(Enum):
    INDEL = "indel"
    REGION_DISCOVERY = "region_discovery"
    BOUNDARY_EXACTNESS = "boundary_exactness"
    NUCLEOTIDE_CLASSIFICATION = "nucleotide_classification"
    FRAMESHIFT = "frameshift"
    STRUCTURAL_COHERENCE = "structural_coherence"
    DIAGNOSTIC_DEPTH = "diagnostic_depth"


class LocusMatching(Enum):
    FULL_DISCOVERY = "full_discovery"
    BEST_PER_LOCUS = "best_per_locus"


ARRAY_DEFAULTS = (Metric.REGION_DISCOVERY, Metric.BOUNDARY_EXACTNESS, Metric.NUCLEOTIDE_CLASSIFICATION)
GFF_DEFAULTS = (Metric.REGION_DISCOVERY, Metric.BOUNDARY_EXACTNESS)
FULL_SWEEP = tuple(Metric)

# Fixed values.
#: Intron inference on long axes: the length from which a cutoff applies, the multiple of a typical gap, the jump that splits gap lengths.
LARGE_AXIS, TYPICAL_GAPS, GAP_JUMP = 1_000_000, 20, 5.0
#: Half-widths of the bias matrix and of the reliability matrix; bins of the position histogram.
BIAS, RELIABILITY, POSITION_BINS = 10, 10, 100
