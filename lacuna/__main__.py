import sys

from lacuna.cli import main

sys.exit(main())
