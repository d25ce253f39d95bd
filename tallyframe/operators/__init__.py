"""Sketches as relations: build is a projection and an aggregation, merge a union and the same aggregation."""


class SketchMergeError(ValueError):
    """Sketches of different parameters or kinds can't be merged."""
