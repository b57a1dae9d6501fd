"""Registered queries of the core, by module."""

CATALOGS = ["tesserae.plans.redelivery", "tesserae.plans.usage", "tesserae.plans.text", "tesserae.plans.evidence", "tesserae.plans.streams", "tesserae.plans.reports", "tesserae.plans.records"]
