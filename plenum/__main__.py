"""python -m plenum: the stages end to end."""

import sys

from .pipeline import main

sys.exit(main())
