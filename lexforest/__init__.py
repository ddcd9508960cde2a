"""Spark-native text-complexity analytics: lexical and syntactic measures over documents."""

__version__ = "0.2.0"
