"""Scalar helpers as Column expressions."""

from .tails import chi2_sf, normal_sf, t_quantile

__all__ = ["chi2_sf", "normal_sf", "t_quantile"]
