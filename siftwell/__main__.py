import sys

from siftwell.cli import main

sys.exit(main())
