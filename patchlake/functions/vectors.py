"""Column expressions on arrays of floats, and the same on rows of a matrix."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def normalize(vector: Column, length: Column) -> Column:
    """Scale to length 1 given the length; a zero vector stays as it is."""
    scaled = F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
    return F.when(length > 0, scaled).otherwise(vector)


def unit_rows(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors of one length, which lie in `flat` between `ends`, as rows that are scaled as `normalize` does. Squares are added up in
    the order of the elements, as in `norm`."""
    width = ends[1] - ends[0]
    if (np.diff(ends) != width).any():
        raise ValueError("vectors that are compared differ in length")
    made = flat[ends[0] : ends[-1]].reshape(len(ends) - 1, width).astype(np.float64)
    squares = np.zeros(len(made))
    for column in made.T:
        squares += column * column
    length = np.sqrt(squares)
    scaled = length != 0  # also where it is no number
    made[scaled] = (made[scaled] / length[scaled, None]).astype(np.float32)
    return made
