"""Ages of relatives from the head's band. All are self-contained column expressions."""

from pyspark.sql import Column, functions as F

from .. import constants as K
from ..functions.numeric import clamp
from ..functions.text import recode
from ..functions.uniform import uniform
from .draws import bernoulli, pick, whole_normal


def head_band(label: Column, key: str, salt: str = "head", seed: int = 0) -> Column:
    """Head label to band code; the open label is split at random over the top bands."""
    open_top = pick(K.HEAD_OPEN_SPLIT, uniform(key, salt=salt, seed=seed))
    return F.when(label == K.HEAD_OPEN_LABEL, open_top).otherwise(recode(label, K.HEAD_TO_BAND))


def partner_band(head: Column, key: str, same: float = K.SAME_BAND_PARTNER, salt: str = "partner", seed: int = 0) -> Column:
    """The head's band, or one below it with probability 1 - same."""
    gap = bernoulli(1.0 - same, uniform(key, salt=salt, seed=seed))
    return clamp(head - gap, *K.PARTNER_RANGE)


def child_band(parent: Column, *keys: str, salt: str = "child", seed: int = 0) -> Column:
    """The parent's band less a drawn age at birth, never below the lowest band."""
    mean, sd = K.BIRTH_GAP
    born = whole_normal(
        *keys, mean=mean, sd=sd, low=K.BIRTH_GAP_MIN, high=parent, salt=salt, seed=seed
    )
    return F.greatest(F.lit(1), parent - born)


def parent_band(head: Column, *keys: str, salt: str = "parent", seed: int = 0) -> Column:
    """The head's band plus a drawn gap; NULL for a head in the top band."""
    mean, sd = K.PARENT_GAP
    low, high = K.PARENT_GAP_RANGE
    gap = whole_normal(*keys, mean=mean, sd=sd, low=low, high=high, salt=salt, seed=seed)
    return F.when(head < K.BAND_CODES[-1], clamp(head + gap, *K.PARENT_RANGE))
