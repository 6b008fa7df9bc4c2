"""``python -m rollcall TABLE_ROOT QUESTION ...`` runs the command line."""

import sys

from rollcall.cli import run

run(sys.argv[1:])
