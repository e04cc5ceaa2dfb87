"""Column functions: coordinates, profiles, codes."""

from .columns import *  # noqa: F403
