"""Launcher for the four jobs: ``spark-submit jobs.py x2 train.csv test.csv out 50 20``.

Only the driver runs Python in these four jobs (all work is JVM-side, no Python UDFs), so the package needs to be
importable on the driver only. The training-data operators run Python in tasks: ship the package to
the executors for them (``--py-files forestlens.zip``, or an installed wheel)."""

import sys

from forestlens.plans.cli import run

if __name__ == "__main__":
    sys.exit(run())
