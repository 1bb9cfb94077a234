"""``python -m streamweave``."""

import sys

from . import operators  # noqa: F401
from .cli import main

sys.exit(main())
