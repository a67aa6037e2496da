"""Job-posting analytics on Spark: normalise, load, report, explore and model a lake of postings."""
