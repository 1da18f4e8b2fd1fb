"""The builders of packets under the name that the tests use."""

from wirelake.decode.packets import *  # noqa: F403
