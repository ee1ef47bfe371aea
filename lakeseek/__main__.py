import sys

from lakeseek.plans.session import main

sys.exit(main())
