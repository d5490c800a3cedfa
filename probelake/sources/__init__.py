"""Readers and writers: FASTQ pairs, panels, whitelists, matrices, 10x outputs, slides, and the Parquet star schema."""

from .fastq import FastqSource, discover, pair_up, read_fastqs
from .star import read_counts, read_star, write_star
from .tenx import discover_plexes, matrix_folder, possible_barcodes, read_chemistry, read_metrics, read_slide, read_table, read_well_list, read_wta, read_wta_barcodes, slide_positions
from .text import read_coordinates, read_mtx, read_panel, read_sam_tags, read_truth, read_whitelist, write_unmapped

__all__ = [
    "FastqSource", "discover", "discover_plexes", "matrix_folder", "pair_up", "possible_barcodes", "read_chemistry", "read_coordinates", "read_counts", "read_fastqs", "read_metrics", "read_mtx", "read_panel",
    "read_sam_tags", "read_slide", "read_star", "read_table", "read_truth", "read_well_list", "read_whitelist", "read_wta", "read_wta_barcodes", "slide_positions", "write_star", "write_unmapped",
]
