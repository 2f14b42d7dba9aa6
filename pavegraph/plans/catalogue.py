"""All registered queries on tiles, shapes, networks and masks."""

from __future__ import annotations

from . import endtoend, geometry, masks, networks, overlays, places, shapes, small, sources, tiles, training
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "endtoend", "geometry", "masks", "networks", "overlays", "places", "shapes", "small", "sources", "tiles", "training"]
