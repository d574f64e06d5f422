"""Rows of a query against rows of SQL, whatever their order."""

import math

import numpy as np


def value(x):
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(value(y) for y in x)
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        f = float(x)
        return int(f) if f == int(f) else f
    return str(x)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(value(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
