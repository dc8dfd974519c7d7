"""Appointment-history analytics as Spark DataFrame operators."""
