"""Match and rank large candidate tables against job texts on Spark."""
