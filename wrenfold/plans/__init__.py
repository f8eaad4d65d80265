"""Importing this package registers all queries."""

from wrenfold.operators import aggregates, contacts, costs, extras, filters, formats, joins, media, retrieval, scalars, timetravel, vectorindex, workflow  # noqa: F401
from wrenfold.plans import guards, quality  # noqa: F401
from wrenfold.sources import files, mailbox, paged, sinks  # noqa: F401
from wrenfold.streaming import changes, stateful  # noqa: F401
