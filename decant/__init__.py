"""Decant: decision-distillation data work expressed as Spark jobs."""
