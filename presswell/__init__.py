"""presswell: dated text documents to weekly early-warning signals, on Spark."""
