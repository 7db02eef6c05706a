"""Analytics over web access logs, written as Spark DataFrame operators."""
