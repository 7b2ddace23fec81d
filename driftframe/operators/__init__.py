"""Operators over trajectories."""

from driftframe.operators import rdf as rdf
from driftframe.operators.rdf import angular_spectrum, rdf_nearest_bin, rdf_summary

__all__ = ["angular_spectrum", "rdf", "rdf_nearest_bin", "rdf_summary"]
