"""Column expressions; all run inside the JVM."""

from salescast.functions.columns import (
    bucket,
    combine_layers,
    crossed,
    day_of,
    fold_of,
    smoothed,
)

__all__ = ["bucket", "combine_layers", "crossed", "day_of", "fold_of", "smoothed"]
