import __spark_entry__ as driver
from checks.oracles import ORACLES
from checks.queries import QUERIES

# SQL is too slow for these; test_fuzzy holds them against the definition
WITHOUT_SQL = {"dedup_fuzzy_documents", "dedup_fuzzy_conversations"}


def test_entry_and_registry(spark):
    audit = driver.entry(spark)
    assert audit.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES) and set(QUERIES) <= set(driver.queries())
