"""The size of Arrow batches that texts are handed to Python in."""

from skein.operators.batches import ROWS, frugal, small_batches

__all__ = ["ROWS", "frugal", "small_batches"]
