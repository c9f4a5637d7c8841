"""Settings of datasets and estimators, with validation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from enum import StrEnum


class MeanType(StrEnum):
    HARMONIC = "harmonic"
    WEIGHTED = "weighted"


class ProblemType(StrEnum):
    IDENTITY = "identity"
    CHARACTERISTIC = "characteristic"
    BREMSSTRAHLUNG = "bremsstrahlung"


class Absorption(StrEnum):
    NONE = "none"
    INTERNAL = "internal"
    EXTERNAL = "external"


class FreePath(StrEnum):
    DENSITY = "density"
    MEAN_ATOMIC_NUMBER = "mean_atomic_number"


class Algorithm(StrEnum):
    LOG_SURROGATE = "log_surrogate"
    L2_SURROGATE = "l2_surrogate"
    PROJECTED_GRADIENT = "projected_gradient"
    BMD = "bmd"


class Init(StrEnum):
    RANDOM = "random"
    NNDSVD = "nndsvd"
    NNDSVDA = "nndsvda"
    NNDSVDAR = "nndsvdar"


class Fusion(StrEnum):
    EELS = "eels"
    HAADF = "haadf"


class Classifier(StrEnum):
    SPECTRAL = "spectral"
    REFINED_SPECTRAL = "refined_spectral"
    VCA = "vca"
    REFINED_VCA = "refined_vca"


@dataclass(frozen=True)
class Instrument:
    """Of the measured signal. The take-off angle is the elevation; azimuth and tilt are kept for the record. Thickness: nm."""

    beam_energy: float
    axis_size: int
    axis_scale: float
    axis_offset: float
    elements: tuple[str, ...]
    elevation: float = 22.0
    azimuth: float = 0.0
    tilt: float = 0.0
    thickness: float = 0.0
    density: float = 0.0
    width_slope: float = 0.01
    width_intercept: float = 0.065
    split_elements: tuple[str, ...] = ()
    split_energies: tuple[float, ...] = ()
    absorption_elements: tuple[str, ...] = ()
    absorption_concentrations: tuple[float, ...] = ()
    problem: ProblemType = ProblemType.BREMSSTRAHLUNG
    absorption: Absorption = Absorption.INTERNAL

    def __post_init__(self) -> None:
        ProblemType(self.problem), Absorption(self.absorption)
        if self.axis_size < 2:
            raise ValueError("an energy axis needs two channels")
        if len(self.split_elements) != len(self.split_energies):
            raise ValueError("each split element needs its energy")
        if set(self.split_elements) - set(self.elements):
            raise ValueError("split elements must be among the elements")

    @classmethod
    def from_metadata(cls, metadata: Mapping, axis: Mapping, **given) -> Instrument:
        """From a dataset's nested metadata and its energy axis (size, scale, offset); what is given and isn't None wins.

        Beam energy, detector angles, stage tilt and the sample's elements stand where electron microscopy files have them.
        """

        def at(*path: str):
            here = metadata
            for step in path:
                if step not in here:
                    raise ValueError(f"not in the metadata: {'.'.join(path)}")
                here = here[step]
            return here

        tem = ("Acquisition_instrument", "TEM")
        sources = {
            "beam_energy": lambda: float(at(*tem, "beam_energy")),
            "azimuth": lambda: float(at(*tem, "Detector", "EDS", "azimuth_angle")),
            "elevation": lambda: float(at(*tem, "Detector", "EDS", "elevation_angle")),
            "tilt": lambda: float(at(*tem, "Stage", "tilt_alpha")),
            "axis_size": lambda: int(axis["size"]),
            "axis_scale": lambda: float(axis["scale"]),
            "axis_offset": lambda: float(axis["offset"]),
            "elements": lambda: tuple(at("Sample", "elements")),
        }
        own = {k: v for k, v in given.items() if v is not None}
        return cls(**{k: f() for k, f in sources.items() if k not in own}, **own)

    @property
    def dictionary_columns(self) -> int:
        if self.problem == ProblemType.IDENTITY:
            return self.axis_size
        own = sum(2 if e in self.split_elements else 1 for e in self.elements)
        return own + 2 * (self.problem == ProblemType.BREMSSTRAHLUNG)


@dataclass(frozen=True)
class Fit:
    """Of a factorisation. Simplex constraints exclude each other; l2 excludes both penalties. verbose: the whole-image fit
    prints its loss every ten rounds, and its time."""

    components: int = 2
    init: Init = Init.NNDSVD
    max_iter: int = 100
    seed: int = 0
    algorithm: Algorithm = Algorithm.LOG_SURROGATE
    tol: float = 1e-6
    floor: float = 1e-14
    eps: float = 1e-6
    ridge: float = 0.0
    mu: float = 0.0
    mu_eps: float = 1.0
    simplex_tol: float = 1e-5
    sigma: float = 8.0
    simplex_w: bool = True
    simplex_h: bool = False
    l2: bool = False
    safe: bool = False
    normalise: bool = False
    no_stop: bool = False
    line_search: bool = False
    simplex_rows: tuple[int, ...] | None = None
    verbose: bool = False

    def __post_init__(self) -> None:
        if self.simplex_w and self.simplex_h:
            raise ValueError("W and H can't both lie on a simplex")
        if self.l2 and (self.ridge or self.mu):
            raise ValueError("the l2 loss takes no penalties")
        if Algorithm(self.algorithm) == Algorithm.L2_SURROGATE:
            raise ValueError("the l2 surrogate has no published update of H here; choose another algorithm")
        Init(self.init)
        if self.components < 1 or self.max_iter < 1:
            raise ValueError("components and max_iter must be positive")

    def change(self, **values) -> Fit:
        return replace(self, **values)


@dataclass(frozen=True)
class BlockFit:
    """Of the block-wise pipeline. poisson: blocks are normalised for counting noise before all else."""

    fit: Fit = field(default_factory=Fit)
    clusters: int = 2
    classifier: Classifier = Classifier.REFINED_VCA
    sigma: float = 0.5
    metric: str = "manhattan"
    power: int = 3
    cluster_iter: int = 100
    cluster_tol: float = 1e-10
    separation: int = 0
    seed: int = 0
    solve_by_svd: bool = True
    poisson: bool = False
