"""Per-token divergence estimators between two log-probabilities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import clamp


def kl_token(logp: Column, ref: Column, kind: str) -> Column:
    """A trailing '+' changes gradients only, so its value equals the plain estimator."""
    kind = kind.removesuffix("+")
    diff = logp - ref
    if kind in ("kl", "k1"):
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind in ("mse", "k2"):
        return diff * diff * 0.5
    if kind in ("low_var_kl", "k3"):
        back = clamp(ref - logp, -20, 20)
        return clamp(F.exp(back) - back - 1, -10, 10)
    raise ValueError(f"unsupported divergence estimator: {kind}")
