"""tidewatch: operational-telemetry analyses as Spark DataFrame transformations."""
