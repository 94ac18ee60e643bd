"""Compositions: fitting a model, applying it, experiment grids and evaluation."""
