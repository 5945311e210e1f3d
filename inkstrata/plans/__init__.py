"""The queries of the core; importing a module of this package registers all of them."""

from . import learners, queries, structure  # noqa: F401
