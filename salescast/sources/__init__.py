"""Reading the input tables, writing results, staging statistics."""

from salescast.sources.staging import shared_folder, stage
from salescast.sources.tables import bad_rows, read_table, replace_scores, sound_rows, write_scores

__all__ = ["bad_rows", "read_table", "replace_scores", "shared_folder", "sound_rows", "stage", "write_scores"]
