"""NumPy arrays of tensors and factors, to compare with."""

import numpy as np


def dense(tensor):
    """NumPy array of a tensor; cells given twice are added."""
    out = np.zeros(tensor.shape)
    for row in tensor.frame.collect():
        out[tuple(row[:-1])] += row.value
    return out


def factor(df, length, rank):
    out = np.zeros((length, rank))
    for row in df.collect():
        out[row.idx] = row.vec
    return out
