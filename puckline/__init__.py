"""Spark-native hockey statistics: ingestion, player-game stats, DvP and hit rates."""
