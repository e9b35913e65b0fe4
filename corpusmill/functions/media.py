"""Identities of decoded pictures and clips, from pixels that a reader has decoded.

No image library is assumed: callers pass pixel bytes, or the 32 x 32 luma that they scaled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, LOW = 32, 8


def rgb_identity(width: Column, height: Column, pixels: Column) -> Column:
    """SHA-256 over the size and the RGB bytes: equal pictures of another shape differ."""
    return F.sha2(F.concat(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")).cast("binary"), pixels), 256)


def _low_terms() -> np.ndarray:
    """One row a low term of the two-dimensional cosine transform, over the pixels of a picture."""
    wave = np.cos(np.pi * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5) / SIDE)
    return np.einsum("ux,vy->uvxy", wave, wave).reshape(LOW * LOW, SIDE * SIDE)


def luma_hashes(lumas: np.ndarray) -> np.ndarray:
    """64-bit perceptual hashes of pictures, a row of 1,024 luma values each.

    A bit is set where a low cosine term lies above the median of all but the constant one; the
    first term is the highest bit.
    """
    terms = np.asarray(lumas, dtype=np.float64).reshape(-1, SIDE * SIDE) @ _low_terms().T
    above = terms > np.median(terms[:, 1:], axis=1, keepdims=True)
    return (above.astype(np.uint64) << np.arange(63, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def perceptual_hash(luma: Column) -> Column:
    """Hexadecimal hash of an array of 1,024 luma values; null for null or another length."""

    @F.pandas_udf("string")
    def on(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        whole = s[[x is not None and len(x) == SIDE * SIDE for x in s]]
        if len(whole):
            out[whole.index] = [f"{h:016x}" for h in luma_hashes(np.stack(whole.to_numpy())).tolist()]
        return out

    return on(luma)
