from sievebench.pipeline import cli

raise SystemExit(cli())
