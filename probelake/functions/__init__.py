"""Scalar functions as Spark column expressions; all stay inside whole-stage code generation where Spark allows it."""

from .expr import (
    bin_coordinates,
    complement,
    gene_of,
    hamming_encoded,
    int_to_hash,
    max_distance,
    max_distance_floor,
    phred_probabilities,
    reverse_complement,
    strip_suffix,
    substitutions,
    two_bit,
)

__all__ = [
    "bin_coordinates", "complement", "gene_of", "hamming_encoded", "int_to_hash", "max_distance", "max_distance_floor",
    "phred_probabilities", "reverse_complement", "strip_suffix", "substitutions", "two_bit",
]
