from .items import items_from, items_from_lines, read_item_stream, read_items
from .points import points_from, points_from_lines, read_points
from .text import lines_from, read_lines

__all__ = [
    "items_from",
    "items_from_lines",
    "lines_from",
    "points_from",
    "points_from_lines",
    "read_item_stream",
    "read_items",
    "read_lines",
    "read_points",
]
