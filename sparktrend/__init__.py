"""Robust detrending of very many irregular time series on Spark."""

from sparktrend.functions.scalars import clean, t14, transit_mask
from sparktrend.functions.sql import register_sql
from sparktrend.operators.clip import sigma_clip, slide_clip
from sparktrend.operators.flatten import flatten, nsplines
from sparktrend.operators.periodogram import lomb_scargle
from sparktrend.operators.segments import segment, segment_durations
from sparktrend.plans.params import METHODS
from sparktrend.sources.fits import read_fits, write_fits

__all__ = ["METHODS", "clean", "flatten", "lomb_scargle", "nsplines", "read_fits", "register_sql", "segment", "segment_durations", "sigma_clip", "slide_clip", "t14", "transit_mask", "write_fits"]
