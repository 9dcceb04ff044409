"""Registered queries over the driver tables, each with its SQL twin."""

from scorelake.catalog import bands, documents, labels, matching, pages, reports, scores, splits, streams, textlines  # noqa: F401
from scorelake.catalog.base import ORACLES, QUERIES  # noqa: F401
