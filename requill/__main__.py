import sys

from requill.cli import main

sys.exit(main())
