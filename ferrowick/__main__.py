import sys

from ferrowick.cli import main

sys.exit(main())
