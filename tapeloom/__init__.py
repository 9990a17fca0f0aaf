"""Spark-native relational engine for collections of block-structured media."""
