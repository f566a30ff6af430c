"""Fleet analytics on Spark: lazy DataFrame-to-DataFrame operators over assets, telemetry, maintenance and text."""
