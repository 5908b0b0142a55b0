"""Parameters of a study: populations, threshold grid, label order, comparisons."""

from __future__ import annotations

from dataclasses import dataclass

# The abundance thresholds of the grid (percent).
THRESHOLDS = (
    1e-06, 1e-05, 5e-05, 1e-04, 5e-04, 0.001, 0.002, 0.003, 0.004, 0.005, 0.006, 0.007, 0.008, 0.009, 0.01,
    0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 5.0,
)

# Population of datasets for the hypergeometric test, and universe of the 2x2 table.
N_TOTAL = 29_289_124
N_UNIVERSE = 34_724_088

# Fixed value: the score that stands for a probability that underflows to zero.
LEAST_P = 1e-323

# Labels in order of priority, spelled as the comparisons spell them (a choice of this library, and a parameter).
PRIORITY = ("Positive Control", "Negative Control", "Commensal", "PHI-Base")
# The comparisons (name, positive class, negative class).
COMPARISONS = (
    ("Pos vs Neg", "Positive Control", "Negative Control"),
    ("Pos vs Random", "Positive Control", "Random"),
    ("Comm vs Neg", "Commensal", "Negative Control"),
    ("Comm vs Random", "Commensal", "Random"),
    ("PHI vs Neg", "PHI-Base", "Negative Control"),
    ("PHI vs Random", "PHI-Base", "Random"),
)


@dataclass(frozen=True)
class Study:
    thresholds: tuple[float, ...] = THRESHOLDS
    n_total: int = N_TOTAL
    n_universe: int = N_UNIVERSE
    dims: int = 512
    sample_n: int = 100
    seed: int = 42
    priority: tuple[str, ...] = PRIORITY
    comparisons: tuple[tuple[str, str, str], ...] = COMPARISONS
