"""Robust detrending of irregular time series on Spark."""
