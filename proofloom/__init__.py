"""Catalogue reconciliation and evidence lineage as Spark DataFrame operators."""
