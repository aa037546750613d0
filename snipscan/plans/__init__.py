"""Queries over the driver's tables, with the SQL that states their results."""

from snipscan.plans import claims as claims
from snipscan.plans import kept as kept
from snipscan.plans import sources as sources
from snipscan.plans import streams as streams
