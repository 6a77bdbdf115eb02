"""flowloom: network-flow features, sampling, detectors and evaluation as Spark DataFrame jobs."""

from flowloom.session import configure

__all__ = ["configure"]
