"""tidewatch: ordered, event-time behavioural detections on Spark DataFrames."""
