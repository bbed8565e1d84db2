import sys

from pointweave.cli import main

sys.exit(main())
