"""sparkloom: record, event and text analytics written as plain PySpark jobs."""
