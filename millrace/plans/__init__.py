"""The registered queries: catalog has them all, the others add to it."""

from . import catalog, forests, latent, more, searches, wide_trees  # noqa: F401
