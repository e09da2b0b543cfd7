"""Where Unicode tables come from: ICU in Spark's jars (icu), or a directory of Unicode data files (ucd)."""
