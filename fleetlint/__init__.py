"""fleetlint: source-corpus quality analytics over a fleet of repositories, on Spark."""
