"""Spark-native analytics for monitored media: articles, polls, positions, quizzes and pipeline health."""
