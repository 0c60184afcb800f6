"""Provenance questions over fleets of workflow runs, as Spark DataFrame operators."""
