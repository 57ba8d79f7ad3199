"""Registered queries; importing the package registers all."""

from ternfield.plans import catalog, detection, further, learning, models, spectra, streams  # noqa: F401
