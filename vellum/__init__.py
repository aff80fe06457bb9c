"""vellum: transcription analytics on Spark."""
