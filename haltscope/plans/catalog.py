"""Everything registered, in one place."""

from haltscope.plans import bars, filings, halts, streams  # noqa: F401
from haltscope.plans.registry import runnable, statements  # noqa: F401
