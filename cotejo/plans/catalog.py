"""Importing this module registers every named query."""

from cotejo.plans import queries_rules  # noqa: F401,I001
from cotejo.plans import queries_products  # noqa: F401
from cotejo.plans import queries_text  # noqa: F401
from cotejo.plans import queries_layout  # noqa: F401
from cotejo.plans import queries_mapping  # noqa: F401
from cotejo.plans import queries_reading  # noqa: F401
from cotejo.plans import queries_trial  # noqa: F401
