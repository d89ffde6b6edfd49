import sys

from lexframe.cli import main

sys.exit(main())
