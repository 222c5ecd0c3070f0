"""quaver: Spark-native analytics over candle and tick series, plus training-data operators in quaver.llm."""
