"""Brute-force versions that several tests use."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_jaccard import brute as jaccard_brute  # noqa: E402, F401
from test_packing import check as packing_check  # noqa: E402, F401
