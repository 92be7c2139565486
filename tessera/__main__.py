"""Runs the command line."""

from tessera.cli import main

raise SystemExit(main())
