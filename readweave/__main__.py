"""python -m readweave: the assembly of a FASTA file from the command line."""

import sys

from .cli import main

sys.exit(main())
