import sys

from salescast.plans.run import main

if len(sys.argv) != 2:
    sys.exit("usage: python -m salescast settings.json")
main(sys.argv[1])
