import sys

from gristmill.cli import main

sys.exit(main())
