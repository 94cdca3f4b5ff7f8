"""All queries outside the training-data subpackage, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans import analytics, clinical_fhir, clinical_flows, clinical_hl7, clinical_tables, devices, learning, mutation, relational, running, surfaces, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (relational, analytics, mutation, clinical_hl7, clinical_fhir, clinical_flows, clinical_tables, surfaces, running, learning, vocabulary, devices):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
