"""Registered queries; importing the package fills the registry."""

from . import registry  # noqa: F401
from . import code, corpus, more, qa, streams, training  # noqa: F401
