"""Two layers of trees that are given, not fitted: fixed values, kept in a file."""

from __future__ import annotations

import json
from functools import lru_cache
from importlib.resources import files


@lru_cache(maxsize=1)
def fixed_layers() -> dict:
    """``features`` and the trees of both layers, ``buy`` and ``amount``, as ``trees_of`` gives them."""
    return json.loads(files("salescast.plans").joinpath("fixed_layers.json").read_text())
